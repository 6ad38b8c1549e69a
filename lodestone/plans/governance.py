"""Queries on governed values: samples, rules, canonical items, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort, govern
from .policy import Cohort, Profile, Rule, pads
from .registry import query, table

#: A published test secret: these queries show no real data.
SECRET = bytes([0x42]) * 32
CUSTOMERS = Cohort("customer", "k1", ("c_custkey",), 20, scope="project", predicates=(("c_mktsegment", "BUILDING"),))
SEGMENTS = Cohort("customer", "k1", ("c_custkey", "c_nationkey"), 5, scope="segment")
PROFILE = Profile(
    "developer",
    (
        Rule("name", "tables", "customer", "attribute", "c_name", "pseudonymize", key_id="k1", scope="project"),
        Rule("segment", "tables", "customer", "attribute", "c_mktsegment", "hash"),
        Rule("balance", "tables", "customer", "attribute", "c_acctbal", "omit"),
        Rule("body", "objects", "pages", "body", "", "hash", content_types=("text/html",)),
        Rule("owner", "objects", "documents", "metadata", "OWNER", "replace", replacement="nobody"),
        Rule("lang", "objects", "documents", "metadata", "lang", "hash"),
        Rule("secret", "objects", "documents", "metadata", "Secret", "omit"),
    ),
    (CUSTOMERS,),
    SECRET,
)
REPLACING = Profile("plain", (Rule("name", "tables", "customer", "attribute", "c_name", "replace", replacement="customer"),))
RULES = {r.id: r for r in PROFILE.rules}


def _hmac_sql(key: bytes, message: str) -> str:
    inner, outer = (p.hex() for p in pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


def _prefixed_sql(value: str) -> str:
    return f"(unhex(printf('%016x', strlen({value}::VARCHAR))) || encode({value}::VARCHAR))"


_NAME = f"'pseudonym/v1:' || {_hmac_sql(PROFILE.rule_key(RULES['name']), 'encode(c_name)')}"
_RANK = _hmac_sql(PROFILE.rank_key(CUSTOMERS), _prefixed_sql("c_custkey"))
_RANK2 = _hmac_sql(PROFILE.rank_key(SEGMENTS), f"{_prefixed_sql('c_custkey')} || {_prefixed_sql('c_nationkey')}")


@query(
    f"""WITH r AS (SELECT *, {_RANK} AS rank FROM customer WHERE c_mktsegment = 'BUILDING'),
    k AS (SELECT * FROM r ORDER BY rank, c_custkey LIMIT 20)
    SELECT rank, '{{"c_custkey":{{"N":"' || c_custkey || '"}},"c_mktsegment":{{"S":"hash/v1:' || sha256(c_mktsegment) || '"}},"c_name":{{"S":"' || {_NAME} || '"}},"c_nationkey":{{"N":"' || c_nationkey || '"}}}}' AS item FROM k"""
)
def top1_cohort_customers(spark, sf_dir):
    """The governed cohort: predicate, keyed rank, limit, rules, canonical items in order."""
    chosen = cohort.select(table(spark, sf_dir, "customer"), PROFILE, CUSTOMERS, F.col("c_custkey"))
    governed = govern.govern_attributes(chosen, PROFILE, "customer")
    kinds = {"c_custkey": "N", "c_name": "S", "c_nationkey": "N", "c_mktsegment": "S"}
    item = C.canonical_item({n: C.typed(k, F.col(n)) for n, k in kinds.items()})
    return governed.select("rank", item.alias("item")).orderBy("item")


@query(
    f"""WITH r AS (SELECT *, {_RANK2} AS rank FROM customer)
    SELECT c_mktsegment, rank, c_custkey, rn FROM (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY rank, c_custkey))::INTEGER AS rn FROM r) WHERE rn <= 5"""
)
def top1_cohort_per_segment(spark, sf_dir):
    return cohort.select_per(table(spark, sf_dir, "customer"), PROFILE, SEGMENTS, ["c_mktsegment"], ["c_custkey"]).select("c_mktsegment", "rank", "c_custkey", "rn")


@query(f"WITH k AS (SELECT c_custkey FROM (SELECT *, {_RANK} AS rank FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY rank, c_custkey LIMIT 20) SELECT sum(32 + strlen(c_custkey::VARCHAR))::BIGINT AS retained_bytes FROM k")
def top2_retained_bytes(spark, sf_dir):
    chosen = cohort.select(table(spark, sf_dir, "customer"), PROFILE, CUSTOMERS, F.col("c_custkey"))
    return cohort.retained_bytes(chosen, F.col("c_custkey").cast("string"))


@query(f"SELECT c_custkey, {_NAME} AS c_name, c_nationkey, 'hash/v1:' || sha256(c_mktsegment) AS c_mktsegment FROM customer")
def prj8_govern_items(spark, sf_dir):
    """All attribute rules of a resource, in order."""
    return govern.govern_attributes(table(spark, sf_dir, "customer"), PROFILE, "customer")


NESTED = Profile(
    "nested",
    (
        Rule("segment", "tables", "customer", "attribute", "profile.segment", "hash"),
        Rule("name", "tables", "customer", "attribute", "profile.contact.name", "replace", replacement="nobody"),
        Rule("balance", "tables", "customer", "attribute", "profile.balance", "omit"),
        Rule("tag", "tables", "customer", "attribute", "tags.segment", "hash"),
        Rule("gone", "tables", "customer", "attribute", "tags.nation", "omit"),
        Rule("none", "tables", "customer", "attribute", "profile.missing", "hash"),
    ),
)


def _nested_customers(spark, sf_dir):
    """Customers as items with a struct in a struct, and a map."""
    rows = table(spark, sf_dir, "customer")
    profile = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("contact"))
    tags = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("c_name"))
    return rows.select("c_custkey", profile.alias("profile"), tags.alias("tags"))


@query(
    """SELECT c_custkey, 'hash/v1:' || sha256(c_mktsegment) AS segment, 'nobody' AS name, c_nationkey AS nation, 'segment,contact' AS fields,
    'hash/v1:' || sha256(c_mktsegment) AS tag, 'name,segment' AS tag_names, c_name AS tag_name FROM customer"""
)
def prj8_nested_rules(spark, sf_dir):
    """Rules on paths through structs and maps: what they name is changed or gone, what lies beside it stays."""
    done = govern.govern_attributes(_nested_customers(spark, sf_dir), NESTED, "customer")
    fields = ",".join(done.schema["profile"].dataType.names)
    return done.select("c_custkey", "profile.segment", "profile.contact.name", "profile.contact.nation", F.lit(fields).alias("fields"), F.col("tags")["segment"].alias("tag"), F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tag_names"), F.col("tags")["name"].alias("tag_name"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def flt1_nested_predicates(spark, sf_dir):
    """A cohort's predicates and keys on nested paths."""
    wanted = Cohort("customer", "k", ("c_custkey", "profile.contact.name"), 1, predicates=(("tags.segment", "BUILDING"), ("profile.contact.nation", 7)))
    return cohort.eligible(_nested_customers(spark, sf_dir), wanted).select("c_custkey")


def _one_rule(rule_id: str, profile: Profile = PROFILE) -> Profile:
    return Profile(profile.name, tuple(r for r in profile.rules if r.id == rule_id), secret=SECRET)


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def prj4_omit(spark, sf_dir):
    return govern.govern_attributes(table(spark, sf_dir, "customer"), _one_rule("balance"), "customer")


@query("SELECT c_custkey, 'customer' AS c_name FROM customer")
def prj5_replace(spark, sf_dir):
    return govern.govern_attributes(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), REPLACING, "customer")


@query("SELECT c_custkey, 'hash/v1:' || sha256(c_mktsegment) AS c_mktsegment FROM customer")
def prj6_hash(spark, sf_dir):
    return govern.govern_attributes(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _one_rule("segment"), "customer")


@query(f"SELECT c_custkey, {_NAME} AS c_name FROM customer")
def prj7_pseudonym(spark, sf_dir):
    return govern.govern_attributes(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _one_rule("name"), "customer")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.no.such') AS missing FROM events")
def prj3_nested_path(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return events.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"), F.try_variant_get("v", "$.no.such", "string").alias("missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def prj2_typed_decode(spark, sf_dir):
    """Tagged items written as JSON and decoded again."""
    item = C.canonical_item({"k": C.typed("N", F.try_variant_get(F.try_parse_json("props"), "$.k", "string"))})
    items = table(spark, sf_dir, "events").select("event_id", item.alias("item"))
    return items.select("event_id", F.try_variant_get(F.parse_json("item"), "$.k.N", "string").alias("k"))


@query(
    """SELECT p_partkey, '{"labels":{"SS":["' || least(p_brand, p_type) || '","' || greatest(p_brand, p_type) || '"]},"p_name":{"S":"' ||
    replace(replace(replace(p_name, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '"},"p_partkey":{"N":"' || p_partkey || '"},"p_size":{"N":"' || p_size || '"}}' AS item FROM part"""
)
def prj1_canonical_item(spark, sf_dir):
    fields = {"p_partkey": C.typed("N", F.col("p_partkey")), "p_name": C.typed("S", F.col("p_name")), "p_size": C.typed("N", F.col("p_size")), "labels": C.typed("SS", F.array("p_type", "p_brand"))}
    return table(spark, sf_dir, "part").select("p_partkey", C.canonical_item(fields).alias("item"))


@query(
    """SELECT doc_id, 'Lang' AS name, 'hash/v1:' || sha256(lang) AS value FROM documents
    UNION ALL SELECT doc_id, 'owner', 'nobody' FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents"""
)
def prj9_metadata_rules(spark, sf_dir):
    metadata = F.create_map(F.lit("Lang"), "lang", F.lit("source"), "source", F.lit("owner"), F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.lit("SECRET"), F.lit("x"))
    rules = [RULES["owner"], RULES["lang"], RULES["secret"]]
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(govern.govern_metadata(metadata, rules)).alias("name", "value"))


@query("SELECT page_id, 'hash/v1:' || sha256(html) AS body, 72::BIGINT AS predicted_bytes FROM pages")
def prj10_body_rule(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"), F.lit("Text/HTML; charset=utf-8").alias("content_type"))
    governed = govern.govern_body(pages, RULES["body"])
    return governed.select("page_id", "body", govern.output_size(RULES["body"], F.octet_length("body")).alias("predicted_bytes"))


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1')")
def flt10_content_types(spark, sf_dir):
    """Objects that a body rule would refuse: here the source stands for the type."""
    rule = Rule("b", "objects", "documents", "body", "", "hash", content_types=("src0", "src1"))
    return govern.body_violations(table(spark, sf_dir, "documents"), rule, "source").select("doc_id")


@query("SELECT event_id, json_object('k', json_extract(props, '$.k'))::VARCHAR AS props FROM events")
def prj14_canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.canonical_json(F.col("props")).alias("props"))


@query("SELECT doc_id, sha256(encode(source) || unhex('00') || encode(doc_id::VARCHAR)) || '.bin' AS name, left(sha256(source), 32) AS folder FROM documents")
def prj17_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.object_name(F.col("source"), F.col("doc_id").cast("string")).alias("name"), C.table_folder(F.col("source")).alias("folder"))


@query(f"SELECT c_custkey, lower(hex({_prefixed_sql('c_name')})) AS encoded FROM customer")
def prj18_length_prefix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(C.length_prefix(F.col("c_name")))).alias("encoded"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def flt1_predicates(spark, sf_dir):
    wanted = Cohort("customer", "k", ("c_custkey",), 1, predicates=(("c_mktsegment", "BUILDING"), ("c_nationkey", 7)))
    return cohort.eligible(table(spark, sf_dir, "customer"), wanted).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice::DECIMAL(15, 1)::VARCHAR = '1000.5' AS one_place, o_orderkey::VARCHAR = '7' AS is_seven FROM orders")
def flt2_number_text(spark, sf_dir):
    """Numbers are equal as text only: 1.0 is not 1."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(15, 1)")
    return orders.select("o_orderkey", cohort.equals(price, "decimal", 1000.5).alias("one_place"), cohort.equals(F.col("o_orderkey"), "bigint", 7).alias("is_seven"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND value IS NOT NULL")
def flt3_missing_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "string"))
    return cohort.eligible(events, Cohort("events", "k", ("k", "value"), 1)).select("event_id")


@query(
    """WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT 'balance' AS rule_id, n AS affected FROM n UNION ALL SELECT 'name', n FROM n UNION ALL SELECT 'segment', n FROM n)
    SELECT rule_id, affected, CASE WHEN affected < 1 THEN '0' WHEN affected < 10 THEN '1-9' WHEN affected < 100 THEN '10-99' WHEN affected < 1000 THEN '100-999' ELSE '1000+' END AS bucket FROM r"""
)
def agg1_rule_counts(spark, sf_dir):
    return govern.rule_counts(table(spark, sf_dir, "customer"), PROFILE, "customer")


@query(
    """SELECT quality, toxic, CASE WHEN n < 1 THEN '0' WHEN n < 10 THEN '1-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS bucket
    FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)"""
)
def agg2_buckets(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return counts.select("quality", "toxic", C.count_bucket(F.col("n")).alias("bucket"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT 'customer' AS resource, CASE WHEN n < 1 THEN '0' WHEN n < 10 THEN '1-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS eligible,
    CASE WHEN least(n, 20) < 1 THEN '0' WHEN least(n, 20) < 10 THEN '1-9' ELSE '10-99' END AS retained, n > 20 AS truncated FROM n"""
)
def agg3_cohort_audit(spark, sf_dir):
    return cohort.audit(table(spark, sf_dir, "customer"), CUSTOMERS)
