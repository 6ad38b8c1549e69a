"""Tagged items against plain Python over random nested items."""

import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import cohort, items
from lodestone.plans.policy import Cohort, Profile, Rule

SECRET = bytes([7]) * 32
WORDS = ["a", "b", "z", "A", "é", "a<b", 'q"uote', "back\\slash", "]", '","', "", "SS\":[", "tab\t", "\\\"", "line\n", "日本", "&", "x" * 90]


def b64(text):
    return base64.b64encode(text.encode()).decode()


def value(r, depth):
    kind = r.choice(items.TAGS if depth else items.TAGS[:8])
    word = lambda: r.choice(WORDS)
    some = lambda: list(dict.fromkeys(word() for _ in range(r.randint(0, 6))))
    if kind in ("BOOL", "NULL"):
        return {kind: r.random() < 0.5}
    if kind in ("N", "NS"):
        numbers = [str(r.randint(-99, 9999)) for _ in range(3)]
        return {kind: numbers[0] if kind == "N" else numbers}
    if kind == "S":
        return {"S": word()}
    if kind == "B":
        return {"B": b64(word())}
    if kind in ("SS", "BS"):
        return {kind: some() if kind == "SS" else [b64(w) for w in some()]}
    if kind == "L":
        return {"L": [value(r, depth - 1) for _ in range(r.randint(0, 4))]}
    return {"M": {n: value(r, depth - 1) for n in r.sample(["a", "b", "SS", "L", "odd name", "é"], r.randint(0, 4))}}


def item(r):
    return {n: value(r, 3) for n in r.sample(["a", "b", "M", "S", "other", "ключ"], r.randint(0, 5))}


def plain(v):
    """Sets in order, at any depth."""
    (tag, body), = v.items()
    if tag in items.SETS:
        return {tag: sorted(body, key=lambda x: x.encode())}
    if tag == "L":
        return {"L": [plain(x) for x in body]}
    return {"M": {k: plain(x) for k, x in body.items()}} if tag == "M" else v


def text_of(own):
    return json.dumps({k: plain(v) for k, v in own.items()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def flat(own):
    out = []

    def walk(v, path):
        (tag, body), = v.items()
        out.append((path, tag))
        for k, x in body.items() if tag == "M" else enumerate(body) if tag == "L" else ():
            walk(x, (*path, str(k)))

    for k, v in own.items():
        walk(v, (k,))
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(11)
    owns = [item(r) for _ in range(150)]
    rows = spark.createDataFrame([(k, json.dumps(o)) for k, o in enumerate(owns)], "id long, text string").repartition(4)
    return owns, rows.select("id", items.parsed(F.col("text")).alias("item"))


def test_canonical_text(made):
    owns, rows = made
    for row in rows.select("id", items.canonical(F.col("item")).alias("text")).collect():
        assert row["text"] == text_of(owns[row["id"]])


def test_the_published_example(spark):
    row = spark.createDataFrame([('{"set":{"SS":["z","a"]},"m":{"M":{"b":{"N":"2"},"a":{"BOOL":true}}}}',)], "t string")
    got = row.select(items.canonical(items.parsed(F.col("t"))).alias("t")).first()["t"]
    assert got == '{"m":{"M":{"a":{"BOOL":true},"b":{"N":"2"}}},"set":{"SS":["a","z"]}}'


def test_leaves_and_back(made):
    owns, rows = made
    found = items.leaves(rows, "id", "item")
    got = {}
    for r in found.select("key", "path", "tag").collect():
        got.setdefault(r["key"], []).append((tuple(r["path"]), r["tag"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: flat(o) for k, o in enumerate(owns) if o}
    assert items.malformed(found).count() == 0
    back = items.assembled(items.encoded(items.decoded(found)), rows.select(F.col("id").alias("key")))
    for r in back.select("key", items.canonical(F.col("item")).alias("text")).collect():
        assert r["text"] == text_of(owns[r["key"]])


def test_malformed_values_are_told(spark):
    bad = {"two": {"S": "x", "N": "1"}, "none": {}, "unknown": {"X": "1"}, "number": {"N": 5}, "flag": {"BOOL": "true"}, "raw": {"B": "*"}, "set": {"SS": "x"}, "list": {"L": {"S": "x"}}, "deep": {"L": [{"M": {"in": {"S": 1}}}]}, "fine": {"NS": ["1"]}, "empty": {"SS": []}}
    rows = spark.createDataFrame([(1, json.dumps(bad))], "id long, text string").select("id", items.parsed(F.col("text")).alias("item"))
    got = {"/".join(r["path"]) for r in items.malformed(items.leaves(rows, "id", "item")).collect()}
    assert got == {"two", "none", "unknown", "number", "flag", "raw", "set", "list", "deep/0/in"}


def governed(own, profile):
    own, met = json.loads(json.dumps(own)), []
    for rule in profile.rules:
        *steps, name = rule.path.split(".")
        at = own
        for s in steps:
            at = at.get(s, {}).get("M") if at is not None else None
        if at is None or name not in at:
            continue
        (tag, body), = at[name].items()
        if tag in (*items.SETS, *items.NESTS) or rule.action != "omit" and tag not in ("S", "B"):
            raise ValueError(rule.id)
        met.append(rule.id)
        if rule.action == "omit":
            del at[name]
            continue
        source = body.encode() if tag == "S" else base64.b64decode(body)
        new = rule.replacement if rule.action == "replace" else "hash/v1:" + hashlib.sha256(source).hexdigest() if rule.action == "hash" else "pseudonym/v1:" + hmac.new(profile.rule_key(rule), source, hashlib.sha256).hexdigest()
        at[name] = {tag: new if tag == "S" else b64(new)}
    return own, met


def rule(name, path, action, **more):
    return Rule(name, "tables", "t", "attribute", path, action, **more)


PROFILE = Profile("p", (rule("one", "a", "hash"), rule("two", "M.a", "replace", replacement="r<&>"), rule("three", "M.b.a", "omit"), rule("four", "S", "pseudonymize", key_id="k", scope="s"), rule("five", "other.odd name", "omit")), secret=SECRET)


def test_rules_reach_through_maps(spark, made):
    owns, _ = made
    fine = []
    for o in owns:
        try:
            governed(o, PROFILE)
            fine.append(o)
        except ValueError:
            continue
    fine += [{"M": {"M": {"a": {"S": "x"}, "b": {"M": {"a": {"N": "5"}, "c": {"NULL": True}}}}}, "a": {"B": b64("raw" * 40)}, "S": {"S": "é"}}, {"other": {"M": {"odd name": {"BOOL": True}}}}, {"M": {"L": []}}]
    rows = spark.createDataFrame([(k, json.dumps(o)) for k, o in enumerate(fine)], "id long, text string").select("id", items.parsed(F.col("text")).alias("item"))
    done = items.govern(rows, "item", PROFILE, "t")
    want = [governed(o, PROFILE) for o in fine]
    for r in done.select("id", items.canonical(F.col("item")).alias("text"), "rules_met").collect():
        assert (r["text"], sorted(r["rules_met"])) == (text_of(want[r["id"]][0]), sorted(want[r["id"]][1]))
    counts = {r["rule_id"]: r["affected"] for r in items.rules_met(done, PROFILE, "t").collect()}
    assert counts == {i: sum(i in m for _, m in want) for i in ("one", "two", "three", "four", "five")} and counts["three"] > 0 and counts["five"] > 0


@pytest.mark.parametrize("held, action", [({"L": []}, "omit"), ({"SS": ["a"]}, "omit"), ({"M": {}}, "hash"), ({"BS": []}, "replace"), ({"N": "1"}, "hash"), ({"BOOL": True}, "replace"), ({"NULL": True}, "hash")])
def test_what_no_rule_may_touch_fails(spark, held, action):
    row = spark.createDataFrame([(json.dumps({"m": {"M": {"x": held}}}),)], "t string").select(items.parsed(F.col("t")).alias("item"))
    with pytest.raises(Exception, match="rule r:"):
        items.govern(row, "item", Profile("p", (rule("r", "m.x", action),)), "t").collect()


def test_predicates_and_keys(spark, made):
    owns, rows = made
    cases = [("a", "b"), ("M.a", True), ("b", 5), ("S", False), ("a", ""), ("M.b.a", "x")]
    got = {r["id"]: r for r in rows.select("id", *[items.matches(F.col("item"), p, w).alias(f"m{k}") for k, (p, w) in enumerate(cases)]).collect()}

    def at(own, path):
        *steps, name = path.split(".")
        for s in steps:
            own = own.get(s, {}).get("M", {})
        return own.get(name)

    def matches(own, path, wanted):
        v = at(own, path)
        if v is None:
            return False
        (tag, body), = v.items()
        if tag == "S":
            return isinstance(wanted, str) and body == wanted
        if tag == "N":
            return body == (str(wanted).lower() if isinstance(wanted, bool) else str(wanted))
        return tag in ("BOOL", "NULL") and isinstance(wanted, bool) and body == wanted

    for k, o in enumerate(owns):
        assert [got[k][f"m{j}"] for j in range(len(cases))] == [matches(o, p, w) for p, w in cases]
    keys = items.with_keys_of(rows, "item", Cohort("t", "k", ("b", "a"), 3))
    want = {k: [C_text(at(o, "a")), C_text(at(o, "b"))] for k, o in enumerate(owns) if at(o, "a") and at(o, "b")}
    assert {r["id"]: [r["key_0"], r["key_1"]] for r in keys.collect()} == want and want


def C_text(v):
    return text_of({"x": v})[5:-1]


def test_columns_named_with_dots(spark):
    rows = spark.createDataFrame([("x", "y", 1), ("z", "w", 2)], "`a.b` string, c string, n long")
    from lodestone.operators import govern

    profile = Profile("p", (Rule("r", "tables", "t", "attribute", "a.b", "hash"), Rule("o", "tables", "t", "attribute", "c", "omit")))
    got = govern.govern_attributes(rows, profile, "t")
    assert got.columns == ["a.b", "n"] and got.first()[0] == "hash/v1:" + hashlib.sha256(b"x").hexdigest()
    assert cohort.select(rows, Profile("p", secret=SECRET), Cohort("t", "k", ("a.b",), 1), F.col("n")).count() == 1


def test_base64_stays_in_one_line(spark):
    got = spark.range(1).select(F.to_json(C.typed("B", F.lit("x" * 300).cast("binary"))).alias("t")).first()["t"]
    assert json.loads(got) == {"B": b64("x" * 300)}


def test_each_costly_step_stands_once_in_the_plan(spark):
    rows = spark.createDataFrame([("{}",)], "t string").select(items.parsed(F.col("t")).alias("item"))
    assert str(items.canonical(F.col("item"))).count("to_json(") == 1 == str(items.tag(F.col("item"))).count("item")

    def steps(*paths):
        done = items.govern(rows, "item", Profile("p", tuple(rule(f"r{k}", p, "hash") for k, p in enumerate(paths))), "t")
        return done._jdf.queryExecution().analyzed().toString().count("Project ")

    # An item is built again once for all rules.
    assert steps("a.b") == steps("a.b", "a.c", "z")


def test_rules_that_meet_in_one_map(spark):
    own = {"a": {"S": "x"}, "b": {"M": {"c": {"S": "y"}, "d": {"B": b64("raw")}}}, "e": {"M": {"f": {"NULL": True}}}}
    profile = Profile("p", (rule("r1", "a", "replace", replacement="new"), rule("r2", "b.c", "omit"), rule("r5", "a.x", "omit"), rule("r6", "b.d", "hash"), rule("r7", "e.f", "omit"), Rule("r8", "others", "t", "attribute", "a", "hash"), Rule("r9", "others", "t", "attribute", "b.c", "hash")))
    rows = spark.createDataFrame([(json.dumps(own),)], "t string").select(items.parsed(F.col("t")).alias("item"))
    got = items.govern(rows, "item", profile, "t").select(items.canonical(F.col("item")).alias("t"), "rules_met").first()
    want, met = governed(own, profile)
    assert (got["t"], got["rules_met"]) == (text_of(want), met) and met == ["r8", "r9", "r1", "r2", "r6", "r7"]


def test_a_file_of_one_task_is_dealt(spark):
    from lodestone.plans import tagged

    assert tagged._customers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
