"""The snapshot operators on small inputs: golden values, decision tables, order invariance."""

import hashlib
import hmac
import io
import random
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import bounds, cohort, compare, govern, graph, ordering, packing, reuse, verify
from lodestone.plans import comparison, governance
from lodestone.plans.policy import Admission, Cohort, PolicyError, Profile, Rule, duration, load_admission, load_profiles
from lodestone.sources import readers, sinks
from lodestone.streaming import capture as streaming

SECRET = b"\x42" * 32


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_hash_and_length_prefix(spark):
    assert one(spark, C.public_hash(F.lit("hello"))) == "hash/v1:" + hashlib.sha256(b"hello").hexdigest()
    assert bytes(one(spark, C.length_prefix(F.lit("é1")))) == (3).to_bytes(8, "big") + "é1".encode()


def test_hmac_is_hmac_and_keys_stay_out_of_plans(spark):
    rule = Rule("r", "tables", "t", "attribute", "a", "pseudonymize", key_id="k")
    profile = Profile("p", (rule,), secret=SECRET)
    rows = spark.createDataFrame([("x",), (None,), ("",)], "a string")
    out = govern.govern_attributes(rows, profile, "t")
    key = profile.rule_key(rule)
    want = {None, *("pseudonym/v1:" + hmac.new(key, v, hashlib.sha256).hexdigest() for v in (b"x", b""))}
    assert {r["a"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().toString().lower()
    assert key.hex() not in plan and bytes(b ^ 0x36 for b in key).hex() not in plan
    assert "42424242" not in repr(profile)


def test_canonical_item(spark):
    item = C.canonical_item({"set": C.typed("SS", F.array(F.lit("z"), F.lit("a"))), "m": F.struct(F.struct(C.typed("BOOL", F.lit(True)).alias("a"), C.typed("N", F.lit("2")).alias("b")).alias("M")), "gone": C.typed("S", F.lit(None))})
    assert one(spark, item) == '{"m":{"M":{"a":{"BOOL":true},"b":{"N":"2"}}},"set":{"SS":["a","z"]}}'
    assert one(spark, C.escaped_json(F.lit('"a<b>&c"'))) == '"a\\u003cb\\u003e\\u0026c"'


def test_cohort_is_the_same_in_any_order(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("c", None)] + [("d", k) for k in range(40)]
    c = Cohort("t", "k1", ("tenant", "id"), 2, scope="project")
    profile = Profile("developer-safe", cohorts=(c,), secret=SECRET)
    got = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "tenant string, id long").repartition(seed + 1)
        got.append(sorted(map(tuple, cohort.select(df, profile, c, F.concat("tenant", F.col("id").cast("string"))).select("tenant", "id").collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 2
    with pytest.raises(ValueError, match="ceiling"):
        cohort.require_ceiling(df, Cohort("t", "k", ("id",), 2, max_retained_bytes=64), F.col("tenant"))


def test_rank_is_an_hmac_over_prefixed_values_in_path_order(spark):
    c = Cohort("t", "k1", ("tenant", "id"), 1)
    profile = Profile("p", cohorts=(c,), secret=SECRET)
    got = cohort.ranked(spark.createDataFrame([("a", 12)], "tenant string, id long"), profile, c).first()["rank"]
    message = b"".join(len(v).to_bytes(8, "big") + v for v in (b"12", b"a"))
    assert got == hmac.new(profile.rank_key(c), message, hashlib.sha256).hexdigest()


def test_typed_equality(spark):
    rows = spark.createDataFrame([("1", 1, True)], "s string, n long, b boolean")
    tests = [("s", "string", "1", True), ("s", "string", 1, False), ("n", "bigint", 1, True), ("n", "bigint", 1.0, False), ("n", "bigint", "1", False), ("b", "boolean", True, True), ("b", "boolean", 1, False), ("n", "bigint", True, False)]
    for name, kind, expected, want in tests:
        assert rows.select(cohort.equals(F.col(name), kind, expected)).first()[0] is want


def test_policies_are_checked():
    with pytest.raises(PolicyError, match="short_secret"):
        Profile("p", (Rule("r", "s", "t", "attribute", "a", "pseudonymize", key_id="k"),), secret=b"x")
    with pytest.raises(PolicyError, match="repeated_target"):
        Profile("p", (Rule("r", "s", "t", "attribute", "a", "omit"), Rule("q", "s", "t", "attribute", "a", "hash")))
    with pytest.raises(PolicyError, match="missing_content_types"):
        Profile("p", (Rule("r", "s", "t", "body", "", "hash"),))
    text = "profiles:\n  p:\n    rules:\n    - {id: r, service: s, resource: t, kind: attribute, path: a, action: hash}\n"
    assert load_profiles(text, "p", {}).rules[0].action == "hash"
    for bad, code in ((text.replace("path", "paht"), "unknown_key"), ("other: 1", "unknown_key")):
        with pytest.raises(PolicyError, match=code):
            load_profiles(bad, "p", {})
    with pytest.raises(PolicyError, match="profile_required"):
        load_profiles(text, None, {})
    with pytest.raises(PolicyError, match="unknown_profile"):
        load_profiles(text, "q", {})
    assert duration("1h30m").total_seconds() == 5400
    a, b = load_admission("allowed_accounts: ['000000000002', '000000000001']"), load_admission("allowed_accounts: ['000000000001', '000000000002']")
    assert a.identity() == b.identity()
    assert governance.PROFILE.identity() == governance.PROFILE.identity()


def test_rules_refuse_other_types(spark):
    rows = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(TypeError):
        govern.govern_attributes(rows, Profile("p", (Rule("r", "s", "t", "attribute", "a", "omit"),)), "t")


def test_body_rule_fails_on_other_types(spark):
    rule = Rule("r", "s", "t", "body", "", "replace", replacement="x", content_types=("text/plain",))
    rows = spark.createDataFrame([("b", "Text/Plain; charset=x"), ("b", "image/png")], "body string, content_type string")
    assert [r["body"] for r in govern.govern_body(rows.where("content_type <> 'image/png'"), rule).collect()] == ["x"]
    assert govern.body_violations(rows, rule).count() == 1
    with pytest.raises(Exception, match="not allowed"):
        govern.govern_body(rows, rule).collect()


def test_scalar_columns(spark):
    assert one(spark, C.visible(F.lit("a\tb"))) == "a\\x09b"
    assert [one(spark, C.bytes_label(F.lit(n))) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KiB", "3.0 MiB", "5.0 GiB"]
    assert [one(spark, C.count_bucket(F.lit(n))) for n in (0, 1, 9, 10, 999, 1000)] == ["0", "1-9", "1-9", "10-99", "100-999", "1000+"]
    assert [one(spark, C.safe_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", "", "a//b", "a\\b", "./a")] == [True, False, False, False, False, False, False]
    assert one(spark, C.canonical_json(F.lit('{"b":1,"a":{"d":1,"c":2}}'))) == '{"a":{"c":2,"d":1},"b":1}'
    assert one(spark, C.canonical_json(F.lit("{no"))) == "{no"
    assert [bounds.log_tail(n) for n in (-1, 0, 7, 10_001)] == [200, 200, 7, 200]


def test_prefixes():
    assert bounds.compact_prefixes(["b", "a", "ab", "b"]) == ["a", "b"]


def pack_by_hand(sizes, most, count=None):
    out, number, held, n = [], 1, 0, 0
    for s in sizes:
        if n and (held + s > most or count and n >= count):
            number, held, n = number + 1, 0, 0
        held, n = held + s, n + 1
        out.append(number)
    return out


@pytest.mark.parametrize("count", [None, 3])
def test_packing(spark, count):
    r = random.Random(1)
    rows = [(g, k, r.choice([0, 1, 5, 40, 200])) for g in ("a", "b", None) for k in range(80)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(3)
    got = {(x["g"], x["k"]): x["pack"] for x in packing.pack(df, "g", ["k"], "n", 100, count).collect()}
    for g in ("a", "b", None):
        assert [got[g, k] for k in range(80)] == pack_by_hand([x[2] for x in rows if x[0] == g], 100, count)


def test_numbering_without_a_global_window(spark):
    rows = [(k * 7 % 101, k % 3, k) for k in range(101)] + [(None, 0, 7)]
    df = spark.createDataFrame(rows, "k long, g int, v long").repartition(4)
    got = sorted((x["rn"], x["k"], x["running"]) for x in ordering.numbered(df, ["k"], total="v", slices=8).collect())
    want, run = [], 0
    for n, (k, _, v) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), 1):
        run += v
        want.append((n, k, run))
    assert got == want
    assert ordering.numbered(df.limit(0), ["k"]).count() == 0


def test_receipt(spark):
    cols = "service string, type string, id string, structure_digest string, governance_digest string"
    b = spark.createDataFrame([("s", "t", "removed", "1", "g"), ("s", "t", "changed", "1", "g"), ("s", "t", "same", "1", "g")], cols)
    c = spark.createDataFrame([("s", "t", "added", "1", "g"), ("s", "t", "changed", "2", "h"), ("s", "t", "same", "1", "g")], cols)
    got = {r["id"]: (r["outcome"], r["categories"]) for r in compare.receipt(b, c).collect()}
    assert got == {"removed": ("removed", []), "changed": ("changed", ["structure", "governance"]), "same": ("unchanged", []), "added": ("added", [])}
    got = {r["id"]: r["categories"] for r in compare.receipt(b, c, source_changed=True).collect()}
    assert got["same"] == ["source"]


def test_reuse_decisions(spark):
    current = spark.createDataFrame([(u, "inventory", "d", 2, 9) for u in "abcdefg"] + [("h", "inventory_unproven", "d", 2, 9)], "unit string, kind string, digest string, records long, bytes long")
    rows = [("a", "inventory", "d", 2, 9, "refreshed", "no_candidate", 1, 1, None), ("b", "inventory", "x", 2, 9, "refreshed", "no_candidate", 1, 1, None), ("c", "inventory", "d", 2, 9, "invalidated", "freshness_unproven", 1, 1, None), ("d", "inventory", "d", 2, 9, "reused", "reused", 1, 1, "artifact_missing"), ("e", "inventory", "d", 2, 9, "reused", "reused", 1, 1, "odd"), ("f", "inventory", "d", 2, 9, "reused", "reused", 2, 1, None), ("h", "inventory_unproven", "d", 2, 9, "reused", "reused", 1, 1, None)]
    candidate = spark.createDataFrame(rows, "unit string, kind string, digest string, records long, bytes long, outcome string, reason string, data_artifacts int, index_artifacts int, artifact_problem string")
    got = {r["unit"]: r["reason"] for r in reuse.decide(current, candidate).collect()}
    assert got == {"a": "reused", "b": "source_content_changed", "c": "freshness_unproven", "d": "artifact_missing", "e": "artifact_corrupt", "f": "source_content_changed", "g": "no_candidate", "h": "source_content_changed"}
    assert {r["reason"] for r in reuse.decide(current, candidate, same_definition=False).collect()} == {"capture_definition_changed"}
    assert {r["reason"] for r in reuse.decide(current, candidate.limit(0), load_invalidation="artifact_missing").collect()} == {"artifact_missing"}
    assert reuse.table_reason(False, True, True, None, None) == "freshness_unproven"
    assert reuse.table_reason(True, True, True, None, None) == "format_changed"


def test_ledger(spark, tmp_path):
    units = spark.createDataFrame([("a", 1)], "unit string, n int")
    reuse.publish(units, f"{tmp_path}/ledger", "g1")
    reuse.publish(units.withColumn("n", F.lit(2)), f"{tmp_path}/ledger", "g2")
    assert [tuple(r) for r in reuse.candidates(spark, f"{tmp_path}/ledger", "g2").collect()] == [("a", 2)]


def test_admission(spark):
    facts = spark.createDataFrame([(1, "000000000001", datetime(2026, 1, 9)), (2, None, None), (3, "000000000001", datetime(2026, 1, 7, 23)), (4, "000000000001", datetime(2026, 1, 8))], "id long, account string, captured_at timestamp_ntz").withColumn("repository", F.lit(None).cast("string")).withColumn("workflow", F.lit(None).cast("string"))
    findings = spark.createDataFrame([(1, "OK", "error"), (1, "BAD", "info"), (3, "BAD", "error"), (3, "BAD", "error")], "id long, code string, severity string")
    policy = Admission(allowed_accounts=("000000000001",), allowed_finding_codes=("OK",), allowed_severities=("info",), max_age="48h")
    got = {r["id"]: r["reasons"] for r in verify.admission_reasons(facts, findings, policy, datetime(2026, 1, 10)).collect()}
    assert got == {1: [], 2: ["capture_time_missing", "source_account_not_allowed"], 3: ["finding_BAD", "fixture_expired"], 4: []}
    none = verify.admission_reasons(facts, findings, Admission(), datetime(2026, 1, 10)).where("allowed").count()
    assert none == 0


def test_coverage_and_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    files = verify.checksums(spark, f"file:{tmp_path}")
    assert sorted((r["path"], r["size"]) for r in files.collect()) == [("b.txt", 3), ("d/a.txt", 3)]
    index = files.where("path <> 'b.txt'").unionAll(spark.createDataFrame([("../x", "0", 1)], "path string, sha256 string, size long"))
    got = sorted(map(tuple, verify.coverage(index, files).collect()))
    assert got == [("../x", "missing_file"), ("../x", "unsafe_path"), ("b.txt", "unexpected_file")]
    with pytest.raises(ValueError, match="coverage"):
        verify.require_none(verify.coverage(index, files), "coverage")


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(k,) for k in range(8)], "node long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (2, 99)], "node long, needs long")
    got = {r["node"]: r["level"] for r in graph.levels(nodes, edges).collect()}
    assert got == {0: 0, 7: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None, 6: None}
    assert sorted(r["node"] for r in graph.in_cycles(nodes, edges).collect()) == [3, 4, 5]


def test_sinks(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(batch):
        import uuid

        (sent / uuid.uuid4().hex).write_text("\n".join(str(r[0]) for r in batch[:20]))
        return batch[20:]

    sinks.put_batches(spark.range(120).repartition(2), send, pause=0.001)
    got = sorted(int(x) for f in sent.iterdir() for x in f.read_text().split())
    assert got == list(range(120))
    with pytest.raises(ValueError):
        sinks.require_shape(spark.range(1), spark.range(1).withColumn("x", F.lit(1)))
    for name in ("staged", "target"):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).touch()
    sinks.install(spark, f"file:{tmp_path}/staged", f"file:{tmp_path}/target")
    assert [p.name for p in (tmp_path / "target").iterdir()] == ["staged"] and not (tmp_path / "target.backup").exists()


def test_packs_are_read_as_streams(spark, tmp_path):
    for k in range(2):
        with tarfile.open(tmp_path / f"p{k}.tar.gz", "w:gz") as tar:
            for n in range(3):
                info = tarfile.TarInfo(f"{k}-{n}.bin")
                info.size = 4
                tar.addfile(info, io.BytesIO(b"%04d" % n))
    got = sorted(r["name"] for r in readers.packed_objects(spark, f"{tmp_path}/*.tar.gz").collect())
    assert got == [f"{k}-{n}.bin" for k in range(2) for n in range(3)]


def test_profile_names_and_guards(spark, tmp_path):
    (tmp_path / "config").write_text("[default]\nkey = v\n[profile dev]\n  [ ops ]\n")
    assert sorted(r["profile"] for r in readers.profile_names(spark, str(tmp_path / "config")).collect()) == ["default", "dev", "ops"]
    readers.structure_only(False)
    with pytest.raises(ValueError):
        readers.structure_only(True)
    with pytest.raises(LookupError):
        readers.log_group(spark.createDataFrame([("ab",)], "n string"), "n", "a")


def test_a_capture_goes_on_only_under_its_definition(spark, tmp_path):
    source, target, state = (f"file:{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = spark.range(10)
    rows.write.parquet(source)
    streaming.capture(spark, source, rows.schema, target, state, "a")
    streaming.capture(spark, source, rows.schema, target, state, "a")
    assert spark.read.parquet(target).count() == 10
    with pytest.raises(ValueError, match="definition"):
        streaming.capture(spark, source, rows.schema, target, state, "b")
    assert streaming.definition("a", {"x": 1, "y": 2}) == streaming.definition("a", {"y": 2, "x": 1})


def test_digests_of_groups_above_the_bundle_limit(spark):
    n = compare.MOST_FILES + 1
    files = spark.range(n).select(F.format_string("%012d", "id").alias("path"), F.lit("s").alias("sha256"), "id").withColumnRenamed("id", "size")
    want = hashlib.sha256("".join(f'{{"path":"{k:012d}","sha256":"s","size":{k}}}\n' for k in range(n)).encode()).hexdigest()
    assert compare.inventory_identity(files.repartition(5)).collect() == [("sha256:" + want, n)]
    assert compare.inventory_identity(files.limit(0)).collect() == [("sha256:" + hashlib.sha256().hexdigest(), 0)]
    with pytest.raises(Exception, match="more than"):
        compare.bundle_identity(files).collect()


def test_the_identity_query_has_no_limit(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(k, f"t{k}") for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(compare, "MOST_FILES", 10)
    lines = "".join(f'{{"path":"{k:012d}","sha256":"{hashlib.sha256(f"t{k}".encode()).hexdigest()}","size":{len(f"t{k}")}}}\n' for k in range(40))
    assert comparison.agg8_bundle_identity(spark, str(tmp_path)).collect() == [("sha256:" + hashlib.sha256(lines.encode()).hexdigest(), 40)]


def test_packs_are_streamed_and_not_gathered(spark):
    rows = [(p, f"k{k:04d}", "e", k, None if p is None and k == 7 else "m") for p in (1, 2, None) for k in range(300)]
    found = compare.pack_freshness(spark.createDataFrame(rows, "pack long, key string, etag string, size long, metadata_digest string").repartition(3), ["pack"])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    line = lambda k, m: f"{sha(f'k{k:04d}')}\x00{sha(f'e\x00{k}\x00{m}')}\n"
    want = {p: sha("".join(line(k, "" if p is None and k == 7 else "m") for k in range(300))) for p in (1, 2, None)}
    kind = lambda p: "inventory_unproven" if p is None else "inventory"
    assert {r["pack"]: (r["kind"], r["digest"], r["records"], r["bytes"]) for r in found.collect()} == {p: (kind(p), d, 300, sum(range(300))) for p, d in want.items()}
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_rules_reach_nested_paths_or_are_refused(spark):
    from lodestone.plans.policy import Cohort, Profile, Rule

    rows = spark.createDataFrame([(1, ("a@b.c", 5), {"email": "a@b.c", "x": "y"}, '{"email": "a@b.c"}'), (2, None, None, None)], "id long, profile struct<email:string,age:int>, tags map<string,string>, raw string")

    def governed(path, what="hash"):
        return govern.govern_attributes(rows, Profile("p", (Rule("r", "s", "t", "attribute", path, what, replacement="z"),)), "t")

    for path in ("profile.email", "tags.email"):
        assert "a@b.c" not in str(governed(path).select(path.split(".")[0]).collect())
        assert "a@b.c" not in str(governed(path, "omit").select(path.split(".")[0]).collect())
    assert governed("profile.email").where("id = 2").first()["profile"] is None
    assert governed("profile.nothing").collect() == rows.collect()
    for path, what in (("raw.email", "hash"), ("profile.age", "hash"), ("profile", "omit"), ("profile.email.x", "omit")):
        with pytest.raises(TypeError):
            governed(path, what)
    met = lambda *predicates: [r["id"] for r in cohort.eligible(rows, Cohort("t", "k", ("id",), 1, predicates=predicates)).collect()]
    assert met(("profile.email", "a@b.c"), ("profile.age", 5), ("tags.x", "y")) == [1] and met(("profile.none", 1)) == []
    with pytest.raises(TypeError):
        met(("raw.email", "a@b.c"))


def test_prefixes_that_no_other_covers(spark):
    import random

    r = random.Random(6)
    prefixes = ["".join(r.choice("ab/é") for _ in range(r.randint(0 if k == 99 else 1, 7))) for k in range(60)]
    for some in (prefixes, [*prefixes, ""], [], ["a", "a", None]):
        rows = spark.createDataFrame([(p,) for p in some], "p string")
        assert sorted(x["p"] for x in bounds.compacted(rows, "p").collect()) == bounds.compact_prefixes([p for p in some if p is not None])


def test_coverage_against_pairs(spark):
    import random

    r = random.Random(2)
    row = lambda: (f"{r.choice(['a', 'b', '../c'])}/{r.randrange(40)}", r.choice("xy"), r.randrange(2))
    index, files = [row() for _ in range(60)], [row() for _ in range(50)]
    want = set()
    for p in {p for p, _, _ in index + files}:
        a, b = [x[1:] for x in index if x[0] == p], [x[1:] for x in files if x[0] == p]
        tests = {"missing_file": not b, "unexpected_file": not a, "duplicate_path": len(a) > 1, "unsafe_path": bool(a) and ".." in p, "size_mismatch": any(x[1] != y[1] for x in a for y in b), "checksum_mismatch": any(x[1] == y[1] and x[0] != y[0] for x in a for y in b)}
        want |= {(p, name) for name, found in tests.items() if found}
    schema = "path string, sha256 string, size long"
    got = verify.coverage(spark.createDataFrame(index, schema), spark.createDataFrame(files, schema)).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_credentials_are_found_as_by_the_patterns_alone(spark):
    value = "=abcdefghijklmnop"
    names = ["aws_secret_access_key", "AWS_Session_Token", "X-Amz-Security-TOKEN", "accessKeyId", "SecretAccessKey", "sessionToken"]
    texts = [f"é İ\n'{n}' : {value[1:]}" for n in names] + [n + value for n in names] + [n + "=short" for n in names] + ["access token" + value, "acces_key" + value, "ſessiontoken" + value, "sessionto\u212aen" + value]
    texts += ["xAKIA" + "B7" * 8, "ASIA" + "B7" * 8, "ASIA" + "b7" * 8, "AKIA", "akia" + "B7" * 8, "", None]
    plain = F.coalesce(F.col("text").rlike(C.CREDENTIALS[0]) | F.col("text").rlike(C.CREDENTIALS[1]), F.lit(False))
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(C.has_credentials(F.col("text")).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found] == [True] * 12 + [False] * 10 + [True] * 2 + [False] * 5
