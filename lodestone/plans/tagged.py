"""Queries on tagged items: canonical text, typed decoding, rules and predicates through maps, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort, items
from .governance import SECRET, _hmac_sql, _prefixed_sql
from .policy import Cohort, Profile, Rule
from .registry import dealt, query, table

#: An item with all ten tags, names and sets out of order; each %s is a column of ``_PARTS``.
_ITEM = (
    r'{"zone":{"N":"%s"},"profile":{"M":{"name":{"S":"%s"},"contact":{"M":{"segment":{"S":"%s"},"active":{"BOOL":%s}}},"blob":{"B":"%s"}}},'
    r'"tags":{"SS":["%s","%s","a<b&\"q\"\\"]},"sizes":{"NS":["10","9","1.50"]},"blobs":{"BS":["Yg==","YQ==","%s"]},"gone":{"NULL":true},'
    r'"history":{"L":[{"S":"%s"},{"M":{"deep":{"L":[{"N":"%s"},{"SS":["z","a"]}]}}}]},"id":{"N":"%s"}}'
)
_PARTS = ("c_nationkey", "c_name", "c_mktsegment", "active", "blob", "c_mktsegment", "c_name", "blob", "c_mktsegment", "c_custkey", "c_custkey")

# What the item is as canonical JSON, for DuckDB.
_QUOTED = r"""'"' || replace(replace(x, '\', '\\'), '"', '\"') || '"'"""
_SET = r"""replace(replace(array_to_string(list_transform(list_sort({list}), lambda x: """ + _QUOTED + r"""), ','), '&', '{amp}'), '<', '{lt}')"""
_TAGS = _SET.format(amp=r"\u0026", lt=r"\u003c", list="""[c_mktsegment, c_name, 'a<b&"q"\\']""".replace("\\\\", "\\"))
_BLOB = "to_base64(encode(c_name))"
_BLOBS = _SET.format(amp="", lt="", list=f"['Yg==', 'YQ==', {_BLOB}]")


def _canonical_sql(contact: str = """{"M":{"active":{"BOOL":' || (c_acctbal > 0) || '},"segment":{"S":"' || c_mktsegment || '"}}}""", profile: str | None = None, gone: str = '"gone":{"NULL":true},') -> str:
    profile = profile or f"""{{"M":{{"blob":{{"B":"' || {_BLOB} || '"}},"contact":{contact},"name":{{"S":"' || c_name || '"}}}}}}"""
    return (
        f"""'{{"blobs":{{"BS":[' || {_BLOBS} || ']}},{gone}"history":{{"L":[{{"S":"' || c_mktsegment || '"}},{{"M":{{"deep":{{"L":[{{"N":"' || c_custkey || '"}},{{"SS":["a","z"]}}]}}}}}}]}},"id":{{"N":"' || c_custkey || """
        f"""'"}},"profile":{profile},"sizes":{{"NS":["1.50","10","9"]}},"tags":{{"SS":[' || {_TAGS} || ']}},"zone":{{"N":"' || c_nationkey || '"}}}}'"""
    )


def _customers(spark, sf_dir):
    """(c_custkey, item): customers as VARIANT items with all ten tags."""
    rows = dealt(table(spark, sf_dir, "customer"), "c_custkey").withColumn("active", F.col("c_acctbal") > 0).withColumn("blob", C.base64_text(F.encode("c_name", "utf-8")))
    return rows.select("c_custkey", items.parsed(F.format_string(_ITEM, *[F.col(c).cast("string") for c in _PARTS])).alias("item"))


@query(f"SELECT c_custkey, {_canonical_sql()} AS item FROM customer")
def prj1_all_tags(spark, sf_dir):
    """Canonical JSON of items with all ten tags: names in order, sets in order at any depth, markup escaped."""
    return _customers(spark, sf_dir).select("c_custkey", items.canonical(F.col("item")).alias("item"))


_VALUES = """SELECT c_custkey, unnest([
    {'path': 'blobs', 'tag': 'BS', 'value': array_to_string(list_sort(['Yg==', 'YQ==', to_base64(encode(c_name))]), ','), 'n': 3, 'depth': 1},
    {'path': 'gone', 'tag': 'NULL', 'value': 'true', 'n': NULL, 'depth': 1},
    {'path': 'history', 'tag': 'L', 'value': NULL, 'n': 2, 'depth': 1},
    {'path': 'history/0', 'tag': 'S', 'value': c_mktsegment, 'n': NULL, 'depth': 2},
    {'path': 'history/1', 'tag': 'M', 'value': NULL, 'n': 1, 'depth': 2},
    {'path': 'history/1/deep', 'tag': 'L', 'value': NULL, 'n': 2, 'depth': 3},
    {'path': 'history/1/deep/0', 'tag': 'N', 'value': c_custkey::VARCHAR, 'n': NULL, 'depth': 4},
    {'path': 'history/1/deep/1', 'tag': 'SS', 'value': 'a,z', 'n': 2, 'depth': 4},
    {'path': 'id', 'tag': 'N', 'value': c_custkey::VARCHAR, 'n': NULL, 'depth': 1},
    {'path': 'profile', 'tag': 'M', 'value': NULL, 'n': 3, 'depth': 1},
    {'path': 'profile/blob', 'tag': 'B', 'value': c_name, 'n': NULL, 'depth': 2},
    {'path': 'profile/contact', 'tag': 'M', 'value': NULL, 'n': 2, 'depth': 2},
    {'path': 'profile/contact/active', 'tag': 'BOOL', 'value': (c_acctbal > 0)::VARCHAR, 'n': NULL, 'depth': 3},
    {'path': 'profile/contact/segment', 'tag': 'S', 'value': c_mktsegment, 'n': NULL, 'depth': 3},
    {'path': 'profile/name', 'tag': 'S', 'value': c_name, 'n': NULL, 'depth': 2},
    {'path': 'sizes', 'tag': 'NS', 'value': '1.50,10,9', 'n': 3, 'depth': 1},
    {'path': 'tags', 'tag': 'SS', 'value': array_to_string(list_sort([c_mktsegment, c_name, 'a<b&"q"\\']), ','), 'n': 3, 'depth': 1},
    {'path': 'zone', 'tag': 'N', 'value': c_nationkey::VARCHAR, 'n': NULL, 'depth': 1}], recursive := true) FROM customer""".replace("\\\\", "\\")


@query(_VALUES)
def prj2_all_tags(spark, sf_dir):
    """Every value of items with all ten tags, decoded by its tag, at any depth."""
    flat = items.decoded(items.leaves(_customers(spark, sf_dir), "c_custkey", "item"))
    value = F.coalesce("text", F.decode("raw", "utf-8"), F.col("flag").cast("string"), F.array_join("members", ","))
    return flat.select(F.col("key").alias("c_custkey"), F.array_join("path", "/").alias("path"), "tag", value.alias("value"), F.col("n").cast("int").alias("n"), "depth")


@query(f"SELECT c_custkey, {_canonical_sql()} AS item FROM customer")
def prj2_tags_roundtrip(spark, sf_dir):
    """Items taken apart by level, decoded, encoded and put together again."""
    flat = items.leaves(_customers(spark, sf_dir), "c_custkey", "item")
    back = items.assembled(items.encoded(items.decoded(flat)))
    return back.select(F.col("key").alias("c_custkey"), items.canonical(F.col("item")).alias("item"))


TAGGED = Profile(
    "tagged",
    (
        Rule("blob", "tables", "customer", "attribute", "profile.blob", "hash"),
        Rule("segment", "tables", "customer", "attribute", "profile.contact.segment", "replace", replacement="some & <any>"),
        Rule("name", "tables", "customer", "attribute", "profile.name", "pseudonymize", key_id="k1", scope="project"),
        Rule("gone", "tables", "customer", "attribute", "gone", "omit"),
        Rule("absent", "tables", "customer", "attribute", "profile.contact.no.such", "omit"),
        Rule("through", "tables", "customer", "attribute", "tags.no", "hash"),
    ),
    secret=SECRET,
)
_KEY = TAGGED.rule_key(next(r for r in TAGGED.rules if r.id == "name"))
_RULED = f"""{{"M":{{"blob":{{"B":"' || to_base64(encode('hash/v1:' || sha256(c_name))) || '"}},"contact":{{"M":{{"active":{{"BOOL":' || (c_acctbal > 0) || '}},"segment":{{"S":"some \\u0026 \\u003cany\\u003e"}}}}}},"name":{{"S":"pseudonym/v1:' || {_hmac_sql(_KEY, "encode(c_name)")} || '"}}}}}}"""


@query(f"SELECT c_custkey, {_canonical_sql(profile=_RULED, gone='')} AS item, 'blob,gone,name,segment' AS rules_met FROM customer")
def prj8_tagged_rules(spark, sf_dir):
    """Rules on paths through maps of tagged items; a missing step meets nothing."""
    done = items.govern(_customers(spark, sf_dir), "item", TAGGED, "customer")
    return done.select("c_custkey", items.canonical(F.col("item")).alias("item"), F.array_join(F.array_sort("rules_met"), ",").alias("rules_met"))


@query("SELECT unnest(['absent', 'blob', 'gone', 'name', 'segment', 'through']) AS rule_id, unnest([0, n, n, n, n, 0]) AS affected FROM (SELECT count(*) AS n FROM customer)")
def agg1_tagged_rule_counts(spark, sf_dir):
    """How many items each rule met, those that met none too."""
    return items.rules_met(items.govern(_customers(spark, sf_dir), "item", TAGGED, "customer"), TAGGED, "customer")


_COHORT = Cohort("customer", "k1", ("profile.name", "history", "id"), 20, scope="project", predicates=(("profile.contact.active", True), ("zone", 7)))
_MESSAGE = " || ".join(_prefixed_sql(x) for x in ("""('{"L":[{"S":"' || c_mktsegment || '"},{"M":{"deep":{"L":[{"N":"' || c_custkey || '"},{"SS":["a","z"]}]}}}]}')""", """('{"N":"' || c_custkey || '"}')""", """('{"S":"' || c_name || '"}')"""))
_SAMPLE = Profile("tagged", cohorts=(_COHORT,), secret=SECRET)


@query(f"SELECT c_custkey, {_hmac_sql(_SAMPLE.rank_key(_COHORT), _MESSAGE)} AS rank FROM customer WHERE c_acctbal > 0 AND c_nationkey = 7 ORDER BY rank LIMIT 20")
def top1_tagged_cohort(spark, sf_dir):
    """A keyed sample of tagged items: predicates and keys lead through maps, ranks take canonical values."""
    keyed = items.with_keys_of(_customers(spark, sf_dir), "item", _COHORT)
    plain = Cohort(_COHORT.resource, _COHORT.key_id, ("key_0", "key_1", "key_2"), _COHORT.limit, scope=_COHORT.scope)
    return cohort.select(keyed, _SAMPLE, plain, F.col("c_custkey")).select("c_custkey", "rank")
