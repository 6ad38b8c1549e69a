"""Queries on digests, comparison, reuse, integrity, admission, dependencies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import compare, graph, reuse, verify
from .policy import Admission
from .registry import query, table

PACKS = 8
ID = compare.IDENTITY


def _entries(spark, sf_dir, changed: bool = False):
    """Documents as inventory entries, dealt into packs; changed: every 50th body differs."""
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if changed else F.col("text")
    key = F.format_string("%012d", "doc_id")
    return docs.select((F.col("doc_id") % PACKS).alias("pack"), key.alias("key"), F.md5(body).alias("etag"), F.octet_length(body).cast("bigint").alias("size"), F.when((F.col("doc_id") % PACKS != 5), F.md5("source")).alias("metadata_digest"))


_FRESH = """SELECT doc_id % 8 AS pack, CASE WHEN doc_id % 8 = 5 THEN 'inventory_unproven' ELSE 'inventory' END AS kind,
  sha256(string_agg(sha256(printf('%012d', doc_id)) || chr(0) || sha256(md5({body}) || chr(0) || strlen({body}) || chr(0) || CASE WHEN doc_id % 8 = 5 THEN '' ELSE md5(source) END) || chr(10), '' ORDER BY doc_id)) AS digest,
  count(*) AS records, sum(strlen({body}))::BIGINT AS bytes FROM documents GROUP BY ALL"""
_SAME = _FRESH.format(body="text")
_OTHER = _FRESH.format(body="(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END)")


@query(_SAME)
def agg8_pack_freshness(spark, sf_dir):
    return compare.pack_freshness(_entries(spark, sf_dir), ["pack"])


@query(
    """SELECT 'sha256:' || sha256(string_agg('{"path":"' || printf('%012d', doc_id) || '","sha256":"' || sha256(text) || '","size":' || strlen(text) || '}' || chr(10), '' ORDER BY doc_id)) AS identity, count(*) AS files FROM documents"""
)
def agg8_bundle_identity(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.format_string("%012d", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    return compare.inventory_identity(files)


def _sides(spark, sf_dir):
    """Orders as resources: before, and after some went, changed and came."""
    orders = table(spark, sf_dir, "orders")
    make = lambda rows, status, price, key: rows.select(F.lit("tables").alias("service"), "o_orderpriority", F.format_string("%010d", key).alias("id"), F.sha2(status, 256).alias("structure_digest"), F.sha2(price.cast("decimal(15, 2)").cast("string"), 256).alias("dataset_digest"), (F.col("o_custkey") % 2 == 0).alias("selected")).withColumnRenamed("o_orderpriority", "type")
    k, status, price = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    before = make(orders, status, price, k)
    kept = make(orders.where("o_orderkey % 10 <> 0"), F.when(k % 7 == 0, F.concat(status, F.lit("x"))).otherwise(status), F.when(k % 21 == 0, price + 1).otherwise(price), k)
    new = make(orders.where("o_orderkey % 13 = 0"), status, price, k + 100_000_000)
    return before, kept.unionAll(new)


_CHANGED = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome,
  CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 <> 0 THEN '' WHEN o_orderkey % 21 = 0 THEN 'structure,dataset' ELSE 'structure' END AS categories, printf('%010d', o_orderkey) AS id, o_orderpriority AS type FROM orders
  UNION ALL SELECT o_orderkey, 'added', '', printf('%010d', o_orderkey + 100000000), o_orderpriority FROM orders WHERE o_orderkey % 13 = 0"""


@query(f"SELECT 'tables' AS service, type, id, outcome, categories FROM ({_CHANGED})")
def joi1_receipt(spark, sf_dir):
    return compare.receipt(*_sides(spark, sf_dir)).withColumn("categories", F.array_join("categories", ","))


@query(f"SELECT category, count(*) AS n FROM (SELECT unnest(string_split(categories, ',')) AS category FROM ({_CHANGED}) WHERE categories <> '') GROUP BY category")
def joi1_categories(spark, sf_dir):
    return compare.receipt(*_sides(spark, sf_dir)).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'removed') AS removed, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM ({_CHANGED})")
def agg6_receipt_counts(spark, sf_dir):
    return compare.outcome_counts(compare.receipt(*_sides(spark, sf_dir)))


@query(
    """SELECT n_name AS service, count(*) AS resources, count(*) FILTER (c_acctbal > 0) AS selected, coalesce(sum(records), 0)::BIGINT AS records, coalesce(sum(bytes), 0)::BIGINT AS bytes
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS records, sum(strlen(o_orderpriority)) AS bytes FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY n_name"""
)
def agg5_service_rollup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    resources = customers.select(F.col("n_name").alias("service"), F.lit("customer").alias("type"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("selected"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("records"), F.sum(F.octet_length("o_orderpriority")).alias("bytes"))
    snapshots = resources.select("service", "type", "id").join(orders, F.col("id") == F.col("o_custkey")).drop("o_custkey")
    return compare.rollup(resources, snapshots)


@query("SELECT source, records FROM (SELECT source, count(*) AS records FROM documents GROUP BY 1) WHERE source IN ('src1', 'src2')")
def agg4_dataset_totals(spark, sf_dir):
    """Datasets whose header is not the sum of its chunks: two headers are made wrong."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.groupBy("source", (F.col("doc_id") % 4).alias("chunk")).agg(F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes"))
    headers = docs.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes"))
    headers = headers.withColumn("bytes", F.when(F.col("source").isin("src1", "src2"), F.col("bytes") + 1).otherwise(F.col("bytes")))
    return compare.dataset_mismatches(headers, chunks, "source").select("source", "records")


_DECISIONS = f"""SELECT a.pack AS unit, CASE WHEN a.pack = 7 THEN 'no_candidate' WHEN a.pack = 6 THEN 'freshness_unproven' WHEN a.kind = 'inventory' AND a.digest = b.digest AND a.records = b.records AND a.bytes = b.bytes
  THEN CASE WHEN a.pack = 1 THEN 'artifact_missing' ELSE 'reused' END ELSE 'source_content_changed' END AS reason FROM ({_OTHER}) a JOIN ({_SAME}) b ON a.pack = b.pack"""


def _decisions(spark, sf_dir):
    current = compare.pack_freshness(_entries(spark, sf_dir, True), ["pack"]).withColumnRenamed("pack", "unit")
    earlier = compare.pack_freshness(_entries(spark, sf_dir), ["pack"]).withColumnRenamed("pack", "unit").where("unit <> 7")
    candidate = earlier.select(
        "*",
        F.when(F.col("unit") == 6, "invalidated").otherwise("refreshed").alias("outcome"),
        F.when(F.col("unit") == 6, "freshness_unproven").otherwise("no_candidate").alias("reason"),
        F.lit(1).alias("data_artifacts"),
        F.lit(1).alias("index_artifacts"),
        F.when(F.col("unit") == 1, "artifact_missing").alias("artifact_problem"),
    )
    return reuse.decide(current, candidate)


@query(f"SELECT unit, CASE WHEN reason = 'reused' THEN 'reused' ELSE 'refreshed' END AS outcome, reason FROM ({_DECISIONS})")
def joi2_reuse_decision(spark, sf_dir):
    return _decisions(spark, sf_dir).select("unit", "outcome", "reason")


@query(
    f"""SELECT unit % 2 AS resource, count(*) FILTER (reason = 'reused') AS reused, count(*) FILTER (reason <> 'reused') AS refreshed, 0::BIGINT AS invalidated, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM ({_DECISIONS}) GROUP BY 1"""
)
def agg7_reasons(spark, sf_dir):
    return reuse.reason_summary(_decisions(spark, sf_dir).withColumn("resource", F.col("unit") % 2), "resource")


@query(
    """SELECT 'objects-missing' AS unit, sha256(p::VARCHAR || chr(0) || n::VARCHAR) AS digest, p - n AS records, 'invalidated' AS outcome, 'source_unit_missing' AS reason
    FROM (SELECT count(*) AS p, count(*) FILTER (doc_id % 9 <> 0) AS n FROM documents)"""
)
def joi12_missing_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    previous = docs.groupBy(F.concat(F.lit("pack-"), (F.col("doc_id") % 4).cast("string")).alias("unit")).agg(F.count("*").alias("records")).withColumn("captured_at", F.lit("2026-01-01T00:00:00Z"))
    current = docs.where("doc_id % 9 <> 0").groupBy((F.col("doc_id") % 4).alias("unit")).agg(F.count("*").alias("records"))
    return reuse.missing_units(previous, current).drop("captured_at")


@query("SELECT doc_id FROM labels WHERE (doc_id % 3 = 0) <> (quality = 1) OR doc_id % 11 = 0")
def joi2_invalid_units(spark, sf_dir):
    """Units whose outcome and reason do not go together, or whose reason is unknown."""
    units = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "reused").otherwise("refreshed").alias("outcome"), F.when(F.col("quality") == 1, "reused").otherwise("no_candidate").alias("reason"))
    units = units.withColumn("reason", F.when(F.col("doc_id") % 11 == 0, "because").otherwise(F.col("reason")))
    return reuse.invalid_units(units).select("doc_id")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS s_name, s_nationkey FROM supplier
    UNION ALL SELECT s_suppkey + 1000000, s_name, 0::INTEGER FROM supplier WHERE s_suppkey % 3 = 1"""
)
def joi3_upsert(spark, sf_dir):
    target = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changed = target.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"), F.lit(None).cast("int").alias("s_nationkey"))
    added = target.where("s_suppkey % 3 = 1").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), "s_name", F.lit(0).alias("s_nationkey"))
    return compare.upsert(target, changed.unionAll(added), ["s_suppkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def joi3_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return compare.last_wins(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT s_suppkey, 'a=1,b=' || s_suppkey || ',c=3' AS tags FROM supplier")
def joi3_tags(spark, sf_dir):
    target = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("old"))
    source = F.create_map(F.lit("b"), F.col("s_suppkey").cast("string"), F.lit("c"), F.lit("3"))
    pairs = F.array_sort(F.transform(F.map_entries(compare.merge_maps(target, source)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(pairs, ",").alias("tags"))


def _edges(spark, sf_dir):
    """Parts as dependencies of orders; some name a part that is not selected or another ARN."""
    arn = F.concat(F.lit("arn:aws:parts:r:1:"), (F.col("l_partkey") % 997).cast("string"), F.when(F.col("l_partkey") % 5 == 0, "-old").otherwise(""))
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select("l_orderkey", "l_partkey", F.lit("parts").alias("to_service"), F.lit("part").alias("to_type"), F.col("l_partkey").alias("to_id"), arn.alias("to_arn")).distinct()
    selected = table(spark, sf_dir, "part").where("p_size < 25").select(F.lit("parts").alias("service"), F.lit("part").alias("type"), F.col("p_partkey").alias("id"), F.concat(F.lit("arn:aws:parts:r:1:"), (F.col("p_partkey") % 997).cast("string")).alias("arn"))
    return edges, selected


_EDGES = "SELECT DISTINCT l_orderkey, l_partkey, l_partkey % 5 <> 0 AND coalesce(p_size < 25, false) AS ok FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"


@query(f"SELECT l_orderkey, l_partkey FROM ({_EDGES}) WHERE ok")
def joi4_resolved(spark, sf_dir):
    return graph.resolved(*_edges(spark, sf_dir)).select("l_orderkey", "l_partkey")


@query(f"SELECT l_orderkey, l_partkey FROM ({_EDGES}) WHERE NOT ok")
def joi5_unresolved(spark, sf_dir):
    return graph.unresolved(*_edges(spark, sf_dir)).select("l_orderkey", "l_partkey")


@query("SELECT s_nationkey AS from_id, 'q' || (s_suppkey % 7) AS to_id, 'sqs' AS to_service FROM supplier GROUP BY ALL")
def joi6_dependencies(spark, sf_dir):
    arn = F.concat(F.lit("arn:aws:sqs:r:123456789012:q"), (F.col("s_suppkey") % 7).cast("string"))
    resources = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(arn).alias("notifications"))
    resources = resources.select(F.lit("objects").alias("service"), F.lit("bucket").alias("type"), F.col("s_nationkey").alias("id"), "notifications")
    return graph.extracted(resources).select("from_id", "to_id", "to_service")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 17 = 0")
def joi7_artifacts(spark, sf_dir):
    """Artifacts of a manifest that the index lacks or has with another size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"))
    index = docs.withColumn("size", F.when(F.col("doc_id") % 17 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return verify.unlisted_artifacts(docs, index).select("doc_id", "sha256")


@query(
    """WITH d AS (SELECT doc_id, 'data/' || doc_id AS path FROM documents)
    SELECT path, 'missing_file' AS problem FROM d WHERE doc_id % 19 = 0 UNION ALL SELECT path || '.new', 'unexpected_file' FROM d WHERE doc_id % 23 = 0
    UNION ALL SELECT path, 'checksum_mismatch' FROM d WHERE doc_id % 29 = 0 AND doc_id % 19 <> 0 UNION ALL SELECT path, 'duplicate_path' FROM d WHERE doc_id % 101 = 0"""
)
def joi8_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("data/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"))
    index = docs.unionAll(docs.where("doc_id % 101 = 0")).drop("doc_id")
    kept = docs.where("doc_id % 19 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 29 == 0, F.lit("other")).otherwise(F.col("sha256")))
    extra = docs.where("doc_id % 23 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    return verify.coverage(index, kept.unionAll(extra).drop("doc_id"))


@query(
    """SELECT r.r_name AS id, sha256(string_agg(n_name || chr(0) || 'apply', '' ORDER BY n_name)) AS operations_digest, '' AS findings_digest FROM region r JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"""
)
def joi9_grouped(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.lit("geo").alias("service"), F.col("r_name").alias("id"), "r_regionkey")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    operations = nations.select("service", F.col("id").alias("resource_id"), F.col("n_name").alias("stage"), F.lit("apply").alias("action"))
    findings = spark.createDataFrame([], "code string, severity string, resource string, property string")
    return compare.grouped_to(regions.drop("r_regionkey"), operations, findings).select("id", "operations_digest", "findings_digest")


@query(
    """WITH f AS (SELECT r_name AS id, 'C' || s_suppkey % 5 AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, s_name AS property FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 1)
    SELECT r_name AS id, coalesce(d, '') AS findings_digest, o AS operations_digest FROM region LEFT JOIN (SELECT id, sha256(string_agg(code || chr(0) || severity || chr(0) || property, '' ORDER BY code || chr(0) || property, severity)) AS d FROM f GROUP BY 1) ON id = r_name
    JOIN (SELECT n_regionkey, sha256(string_agg(n_name || chr(0) || 'apply', '' ORDER BY n_name)) AS o FROM nation GROUP BY 1) ON n_regionkey = r_regionkey"""
)
def joi9_findings_grouped(spark, sf_dir):
    """Digests of the operations and findings of each resource; a resource may have none."""
    regions = table(spark, sf_dir, "region").select(F.lit("geo").alias("service"), F.col("r_name").alias("id"), "r_regionkey")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    operations = nations.select("service", F.col("id").alias("resource_id"), F.col("n_name").alias("stage"), F.lit("apply").alias("action"))
    suppliers = table(spark, sf_dir, "supplier").join(nations.where("r_regionkey <> 1"), F.col("s_nationkey") == F.col("n_nationkey"))
    findings = suppliers.select(F.concat(F.lit("C"), (F.col("s_suppkey") % 5).cast("string")).alias("code"), F.when(F.col("s_suppkey") % 2 == 0, "error").otherwise("warning").alias("severity"), F.col("id").alias("resource"), F.col("s_name").alias("property"))
    return compare.grouped_to(regions.drop("r_regionkey"), operations, findings).select("id", "operations_digest", "findings_digest")


@query("SELECT c_custkey, coalesce(n, 0) AS snapshots FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def joi10_snapshots(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("snapshots"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS units FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def joi11_ledger_units(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    units = F.array_sort(F.collect_list("o_orderkey"))
    return orders.groupBy("o_custkey").agg(F.array_join(F.transform(units, lambda k: k.cast("string")), ",").alias("units"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 31 = 0")
def joi13_provenance(spark, sf_dir):
    keys = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    orders = table(spark, sf_dir, "orders").select(*keys)
    manifest = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 31 == 0, "?").otherwise(F.col("o_orderstatus")))
    return verify.provenance_mismatch(orders, manifest, keys).select("o_orderkey")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 'local:' || s_nationkey ELSE 'arn:' || s_nationkey END AS target FROM supplier")
def joi14_arn_map(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("arn:"), F.col("s_nationkey").cast("string")).alias("target"))
    known = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.concat(F.lit("arn:"), F.col("n_nationkey").cast("string")).alias("captured"), F.concat(F.lit("local:"), F.col("n_nationkey").cast("string")).alias("local"))
    return graph.rewritten(rows, known, "target")


@query(
    """SELECT id, unnest(CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN ['ensure', 'apply', 'link', 'upsert'] WHEN id % 2 = 0 THEN ['ensure', 'apply', 'link'] WHEN id % 3 = 0 THEN ['ensure', 'apply', 'upsert'] ELSE ['ensure', 'apply'] END) AS action
    FROM (SELECT s_suppkey AS id FROM supplier)"""
)
def prj20_operations(spark, sf_dir):
    snapshots = table(spark, sf_dir, "supplier").select(F.lit("queues").alias("service"), F.lit("queue").alias("type"), F.col("s_suppkey").alias("id"))
    return graph.operations(snapshots, F.col("id") % 2 == 0, F.col("id") % 3 == 0).select("id", "action")


@query("SELECT DISTINCT CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'QUALITY' END AS code, CASE WHEN quality = 0 THEN 'error' ELSE 'info' END AS severity, '' AS property FROM labels")
def prj16_finding_projection(spark, sf_dir):
    findings = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "TOXIC").otherwise("QUALITY").alias("code"), F.when(F.col("quality") == 0, "error").otherwise("info").alias("severity"), F.lit("full").alias("support"), F.lit("r").alias("resource"), F.lit("").alias("property"), F.lit("words").alias("message"))
    return compare.finding_projection(findings).select("code", "severity", "property").distinct()


@query("SELECT c_custkey, c_nationkey, NULL::INTEGER AS s_nationkey FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def set1_union(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").unionByName(suppliers, allowMissingColumns=True)


@query("SELECT toxic AS code, count(*) AS n FROM (SELECT toxic FROM labels UNION ALL SELECT quality FROM labels) GROUP BY 1")
def set2_findings(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("toxic").alias("code")).unionAll(labels.select("quality")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set3_key_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set4_except(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(ordered, "c_custkey", "left_anti")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def set5_intersect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def set6_duplicates(spark, sf_dir):
    return compare.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names FROM customer GROUP BY 1")
def agg10_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("segments"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("names"))


@query("SELECT o_custkey, min(o_orderdate) AS first_at, count(*) AS records FROM orders GROUP BY 1")
def agg15_first_and_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.count("*").alias("records"))


@query("SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions FROM events")
def agg16_actions(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("actions"))


POLICY = Admission(allowed_accounts=("000000000001", "000000000002"), allowed_finding_codes=("QUALITY",), allowed_severities=("info",), max_age="48h", producer_repository="r", producer_workflow="w")
NOW = datetime(2026, 1, 10)


@query(
    """WITH f AS (SELECT doc_id AS id, lpad((doc_id % 3 + 1)::VARCHAR, 12, '0') AS account, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 9 END AS day, doc_id % 7 <> 0 AS bound, toxic = 1 AND quality = 0 AS bad FROM labels),
    r AS (SELECT id, list_filter([CASE WHEN bad THEN 'finding_TOXIC' END, CASE WHEN day = 1 THEN 'fixture_expired' END, CASE WHEN day IS NULL THEN 'capture_time_missing' END, CASE WHEN account = '000000000003' THEN 'source_account_not_allowed' END, CASE WHEN NOT bound THEN 'producer_binding_unverified' END], lambda x: x IS NOT NULL) AS reasons FROM f)
    SELECT id, len(reasons) = 0 AS allowed, array_to_string(list_sort(reasons), ',') AS reasons FROM r"""
)
def flt16_admission(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    facts = labels.select(
        k.alias("id"),
        F.lpad((k % 3 + 1).cast("string"), 12, "0").alias("account"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, F.lit("2026-01-01")).otherwise(F.lit("2026-01-09")).cast("timestamp_ntz").alias("captured_at"),
        F.lit("r").alias("repository"),
        F.when(k % 7 == 0, "other").otherwise("w").alias("workflow"),
    )
    findings = labels.select(k.alias("id"), F.when(F.col("toxic") == 1, "TOXIC").otherwise("QUALITY").alias("code"), F.when(F.col("quality") == 0, "error").otherwise("info").alias("severity"))
    return verify.admission_reasons(facts, findings, POLICY, NOW).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'LSI_INCLUDE' WHEN c_custkey % 3 = 1 THEN 'LIFECYCLE' END AS code FROM customer WHERE c_custkey % 3 <> 2")
def flt18_compatibility(spark, sf_dir):
    """Findings where a structure has what an emulator does not support."""
    indexes = F.array(F.struct(F.when(F.col("c_custkey") % 3 == 0, "INCLUDE").otherwise("ALL").alias("projection")))
    code = F.when(F.exists(indexes, lambda i: i["projection"] == "INCLUDE"), "LSI_INCLUDE").when(F.col("c_custkey") % 3 == 1, "LIFECYCLE")
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).where("code IS NOT NULL")


@query("SELECT n_nationkey AS node, CASE WHEN n_nationkey IN (20, 21, 22) THEN NULL WHEN n_nationkey > 22 THEN NULL ELSE n_nationkey % 5 END::INTEGER AS level FROM nation")
def grf2_levels(spark, sf_dir):
    """Levels of a graph of nations: k needs k - 1 within fives; 20 to 22 need each other, 23 and 24 need them."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.levels(nations, _nation_edges(nations))


@query("SELECT n_nationkey AS node FROM nation WHERE n_nationkey BETWEEN 20 AND 22")
def grf1_cycle(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.in_cycles(nations, _nation_edges(nations))


def _nation_edges(nations):
    k = F.col("node")
    needs = F.when((k < 20) & (k % 5 > 0), k - 1).when(k == 20, 22).when(k.isin(21, 22), k - 1).when(k > 22, F.lit(20))
    return nations.select("node", needs.alias("needs")).where("needs IS NOT NULL")
