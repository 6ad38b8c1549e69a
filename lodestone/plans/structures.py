"""Queries on structures: pruning, ordering, optional settings, error classes, the account pin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure
from ..sources import readers
from .registry import dealt, query, table


@query(
    r"""SELECT c_custkey, CASE WHEN k = 0 THEN '{"keep":false,"list":[0,null,{},""],"name":"' || c_name || '","text":"{\"a\":null,\"b\":0}"}'
      WHEN k = 1 THEN '{"deep":{"er":{"est":{"n":' || c_nationkey || '}}},"keep":false,"list":[0,null,{"x":1},""],"name":"' || c_name || '","text":"{\"a\":null,\"b\":0}"}'
      ELSE '{"keep":false,"list":[0,null,{},""],"text":"{\"a\":null,\"b\":0}"}' END AS pruned
    FROM (SELECT c_custkey, c_name, c_nationkey + 1 AS c_nationkey, c_custkey % 3 AS k FROM customer)"""
)
def prj13_pruned(spark, sf_dir):
    """Empty members gone at any depth: those of members that became empty too; lists keep their places, strings their text."""
    item = '{"text":"{\\"a\\":null,\\"b\\":0}","name":"%s","zero":0,"none":null,"keep":false,"gone":[],"float":-0.0e3,"list":[0,null,{"x":%s},""],"deep":{"er":{"est":{"n":%s,"m":{"o":{}}}},"also":""}}'
    k = F.col("c_custkey") % 3
    made = F.format_string(item, F.when(k < 2, F.col("c_name")).otherwise(""), F.when(k == 1, "1").otherwise('""'), F.when(k == 1, (F.col("c_nationkey") + 1).cast("string")).otherwise("0"))
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", structure.pruned(made).alias("pruned"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PROVISIONED' ELSE 'PAY_PER_REQUEST' END AS billing_mode,
      CASE WHEN p_partkey % 3 = 0 THEN 'PROVISIONED' WHEN p_partkey % 3 = 1 THEN 'PAY_PER_REQUEST' ELSE 'ON_DEMAND' END AS source_billing_mode, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS read_capacity,
      array_to_string(list_transform(list_sort([{'n': p_brand, 't': 'S'}, {'n': p_type, 't': 'N'}, {'n': 'pk', 't': 'S'}]), lambda x: x.n || ':' || x.t), ',') AS attributes,
      array_to_string(list_sort([p_type, p_brand, 'Zz', 'aa']), ',') AS projected,
      array_to_string(list_transform(list_sort([{'k': 'team', 'v': p_type}, {'k': 'team', 'v': p_brand}, {'k': 'app', 'v': 'x'}]), lambda x: x.k || '=' || x.v), ',') AS tags FROM part"""
)
def prj12_normalised(spark, sf_dir):
    """Structures in order, and what a copy is billed by."""
    pair = lambda a, b, *v: F.struct(v[0].alias(a), v[1].alias(b))
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(pair("name", "type", F.col("p_type"), F.lit("N")), pair("name", "type", F.lit("pk"), F.lit("S")), pair("name", "type", F.col("p_brand"), F.lit("S"))).alias("attributes"),
        F.array("p_type", F.lit("aa"), F.lit("Zz"), "p_brand").alias("projected"),
        F.array(pair("key", "value", F.lit("team"), F.col("p_type")), pair("key", "value", F.lit("team"), F.col("p_brand")), pair("key", "value", F.lit("app"), F.lit("x"))).alias("tags"),
        F.when(k == 2, "ON_DEMAND").otherwise(F.when(k == 1, "")).alias("billing_mode"),
        F.when(k == 0, F.col("p_size")).alias("read_capacity"),
        F.lit(None).cast("int").alias("write_capacity"),
    )
    done = structure.billed(structure.in_order(rows, {"attributes": ["name"], "projected": [], "tags": ["key", "value"]}), keep_provisioned=True)
    joined = lambda c, a, b, sign: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(sign), x[b])), ",")
    return done.select("p_partkey", "billing_mode", "source_billing_mode", "read_capacity", joined("attributes", "name", "type", ":").alias("attributes"), F.array_join("projected", ",").alias("projected"), joined("tags", "key", "value", "=").alias("tags"))


_READS = """SELECT c_custkey, unnest(['cors', 'tags', 'website']) AS setting, unnest([
    CASE c_custkey % 4 WHEN 0 THEN 'NoSuchCORSConfiguration' WHEN 1 THEN 'AccessDenied' END, CASE c_custkey % 5 WHEN 0 THEN 'NoSuchTagSet' WHEN 1 THEN 'ExpiredToken' WHEN 2 THEN 'NoSuchCORSConfiguration' END, 'NoSuchWebsiteConfiguration']) AS code FROM customer"""
_KINDS = f"""SELECT c_custkey, setting, CASE WHEN code IS NULL THEN 'present' WHEN (setting, code) IN (('cors', 'NoSuchCORSConfiguration'), ('tags', 'NoSuchTagSet'), ('website', 'NoSuchWebsiteConfiguration')) THEN 'absent'
    WHEN code = 'AccessDenied' THEN 'access_denied' WHEN code = 'ExpiredToken' THEN 'authentication' ELSE 'configuration' END AS kind FROM ({_READS})"""


def _reads(spark, sf_dir):
    k = F.col("c_custkey")
    cors = F.when(k % 4 == 0, "NoSuchCORSConfiguration").when(k % 4 == 1, "AccessDenied")
    tags = F.when(k % 5 == 0, "NoSuchTagSet").when(k % 5 == 1, "ExpiredToken").when(k % 5 == 2, "NoSuchCORSConfiguration")
    one = lambda name, code: F.struct(F.lit(name).alias("setting"), code.alias("error_code"), F.when(code.isNull(), F.concat(F.lit('{"z":0,"owner":"'), "c_name", F.lit('"}'))).alias("value"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(one("cors", cors), one("tags", tags), one("website", F.lit("NoSuchWebsiteConfiguration")))).alias("r")).select("c_custkey", "r.*")


@query(f"SELECT * FROM ({_KINDS})")
def flt17_error_classes(spark, sf_dir):
    """What the read of each optional setting came to."""
    return _reads(spark, sf_dir).select("c_custkey", "setting", structure.error_class(F.col("setting"), F.col("error_code")).alias("kind"))


@query(
    f"""SELECT c_custkey, string_agg(CASE WHEN kind = 'present' THEN setting || '={{"owner":"' || c_name || '"}}' END, ',' ORDER BY setting) AS settings, string_agg(CASE WHEN kind NOT IN ('present', 'absent') THEN upper(setting) || '_UNAVAILABLE/' || kind END, ',' ORDER BY setting) AS findings
    FROM ({_KINDS}) JOIN customer USING (c_custkey) GROUP BY c_custkey"""
)
def src7_settings(spark, sf_dir):
    """Optional settings of each resource: the absent are none, the unreadable are findings."""
    found, findings = structure.settings(_reads(spark, sf_dir), "c_custkey")
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    told = findings.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("code", F.lit("/"), "reason"))), ",").alias("findings"))
    return found.join(told, "c_custkey", "left").select("c_custkey", F.nullif(joined, F.lit("")).alias("settings"), "findings")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN '123456789012' END AS account FROM supplier WHERE s_nationkey % 2 = 1 OR s_suppkey % 7 = 0")
def flt19_account_pin(spark, sf_dir):
    """Rows of another account than the pinned one, or of none; and those of it, let through."""
    account = F.when(F.col("s_nationkey") % 2 == 0, "123456789012")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", account.alias("account"))
    let = structure.pinned(rows.where("account IS NOT NULL AND s_suppkey % 7 = 0"), "account", "123456789012")
    return let.unionAll(structure.mismatches(rows, "account", "123456789012"))


def _listed(name, fields):
    """A list of structs as text, an absent one as an empty list."""
    return F.coalesce(F.to_json(F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields]))), F.lit("[]"))


@query(
    """SELECT n_name, coalesce(a, '[]') AS aliases, coalesce(m, '[]') AS mappings FROM nation
    LEFT JOIN (SELECT s_nationkey, '[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']' AS a FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) ON s_nationkey = n_nationkey
    LEFT JOIN (SELECT c_nationkey, '[' || string_agg('{"c_custkey":' || c_custkey || '}', ',' ORDER BY c_custkey) || ']' AS m FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1) ON c_nationkey = n_nationkey"""
)
def src10_two_lists(spark, sf_dir):
    """Functions with their aliases and event sources: two lists beside each other, either may be empty."""
    nations = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    aliases = table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").withColumnRenamed("s_nationkey", "k")
    mappings = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").withColumnRenamed("c_nationkey", "k")
    both = readers.nested(readers.nested(nations, aliases, "k", "aliases", ["s_suppkey", "s_name"]), mappings, "k", "mappings", ["c_custkey"])
    return both.select("n_name", _listed("aliases", ["s_suppkey", "s_name"]).alias("aliases"), _listed("mappings", ["c_custkey"]).alias("mappings"))


@query(
    """WITH n AS (SELECT n_regionkey, n_name, '{"n_name":"' || n_name || '","suppliers":' || coalesce('[' || string_agg('{"s_suppkey":' || s_suppkey || '}', ',' ORDER BY s_suppkey) || ']', '[]') || '}' AS j FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT r_name, '[' || string_agg(j, ',' ORDER BY n_name) || ']' AS nations FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY 1"""
)
def src11_lists_in_lists(spark, sf_dir):
    """An interface with its routes, and each of these with its integrations."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    nations = readers.nested(table(spark, sf_dir, "nation"), suppliers, "n_nationkey", "suppliers", ["s_suppkey"]).withColumn("suppliers", F.coalesce("suppliers", F.array().cast("array<struct<s_suppkey:bigint>>")))
    regions = readers.nested(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "k"), nations.withColumnRenamed("n_regionkey", "k"), "k", "nations", ["n_name", "suppliers"])
    return regions.select("r_name", F.to_json("nations").alias("nations"))


@query("SELECT event_type AS topic, count(*) AS subscriptions, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS listed FROM events WHERE event_id % 20 = 0 GROUP BY 1")
def src12_subscriptions(spark, sf_dir):
    """Topics with their subscriptions in order."""
    events = table(spark, sf_dir, "events").where("event_id % 20 = 0").select(F.col("event_type").alias("topic"), "event_id")
    got = readers.nested(events.select("topic").distinct(), events, "topic", "subscriptions", ["event_id"])
    return got.select("topic", F.size("subscriptions").cast("long").alias("subscriptions"), F.sha2(F.array_join(F.transform("subscriptions", lambda x: x["event_id"].cast("string")), ","), 256).alias("listed"))


@query("SELECT c_custkey, array_to_string(list_transform(list_sort([{'k': 'segment', 'v': c_mktsegment}, {'k': 'nation', 'v': c_nationkey::VARCHAR}, {'k': 'Name', 'v': c_name}, {'k': 'segment', 'v': 'a'}]), lambda x: x.k || '=' || x.v), ',') AS tags FROM customer")
def src14_sorted_tags(spark, sf_dir):
    """Tags by key, then value; capitals first."""
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    tags = F.array(tag("segment", F.col("c_mktsegment")), tag("nation", F.col("c_nationkey").cast("string")), tag("Name", F.col("c_name")), tag("segment", F.lit("a")))
    rows = structure.in_order(table(spark, sf_dir, "customer").select("c_custkey", tags.alias("tags")), {"tags": ["key", "value"]})
    return rows.select("c_custkey", F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",").alias("tags"))
