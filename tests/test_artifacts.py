"""Chunks, packs and the ledger: files against their descriptors, and what is refused."""

import gzip
import hashlib
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import artifacts, files, ledger


@pytest.fixture
def objects(spark):
    rows = [("b" if k % 3 else "a", f"k{k:03d}", f"body {k} é " * (k % 7), "text/plain" if k % 2 else None) for k in range(40)] + [(None, "n1", None, None)]
    return spark.createDataFrame(rows, "bucket string, key string, body string, content_type string").repartition(3)


def local(path):
    return path.removeprefix("file://")


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/root"


def test_parts_are_what_their_descriptors_say(spark, root):
    lines = spark.createDataFrame([("t", k, "x" * (k % 40)) for k in range(300)] + [("t", 900, "y" * 500), ("u", 1, None), (None, 5, "é")], "t string, k long, line string").repartition(4)
    made = artifacts.write_parts(lines, root, "t", ["k"], "line", 256).collect()
    seen = {}
    for r in made:
        raw = open(f"{local(root)}/{r['path']}", "rb").read()
        assert (hashlib.sha256(raw).hexdigest(), len(raw)) == (r["sha256"], r["size"]) and raw[4:8] == b"\0\0\0\0"
        text = gzip.decompress(raw).decode()
        assert text.endswith("\n") and text.count("\n") == r["records"] and len(text.encode()) == r["source_bytes"]
        assert r["source_bytes"] <= 256 or r["records"] == 1
        seen.setdefault(r["t"], {})[r["part"]] = text
    assert "".join(seen["t"][p] for p in sorted(seen["t"])) == "".join("x" * (k % 40) + "\n" for k in range(300)) + "y" * 500 + "\n"
    assert sorted(seen["t"]) == list(range(1, len(seen["t"]) + 1)) and seen[None] == {1: "é\n"} and "u" not in seen
    found = [f for _, _, names in os.walk(local(root)) for f in names if not f.startswith(".")]
    assert len(found) == len(made), "no draft stays"


def test_the_same_lines_make_the_same_files(spark, root, tmp_path):
    lines = spark.createDataFrame([("t", k, f"line {k}") for k in range(100)], "t string, k long, line string")
    one, two = (artifacts.write_parts(lines.repartition(n), f"file://{tmp_path}/{n}", "t", ["k"], "line", 300).select("path", "sha256").collect() for n in (2, 7))
    assert sorted(one) == sorted(two)


def test_a_line_over_the_bound_is_refused_before_anything_is_written(spark, root):
    lines = spark.createDataFrame([("t", 1, "short"), ("t", 2, "x" * 99)], "t string, k long, line string")
    with pytest.raises(ValueError, match="more than 50 bytes"):
        artifacts.write_parts(lines, root, "t", ["k"], "line", 50, oversize="fail")
    assert not os.path.exists(local(root))


@pytest.mark.parametrize("records, size, want, more", [(100, 1000, 5, False), (3, 1000, 3, True), (100, 12, 2, True), (100, 3, 0, None)])
def test_bounded_file(spark, root, records, size, want, more):
    lines = spark.createDataFrame([(k, f"line{k}") for k in range(5)], "k long, line string")
    made = artifacts.write_bounded(lines, root, ["k"], "line", records, size).collect()
    assert [(r["records"], r["truncated"]) for r in made] == ([(want, more)] if want else [])


def test_packs_come_back(objects, root):
    made = artifacts.write_packs(objects, root, "bucket", "key", "body", ["content_type"], 300, 4)
    back = {(r["bucket"], r["key"]): r for r in artifacts.read_packs(made, root, "bucket").collect()}
    rows = objects.collect()
    assert len(back) == len(rows)
    for r in rows:
        raw = (r["body"] or "").encode()
        got = back[r["bucket"], r["key"]]
        assert (bytes(got["body"]), got["size"], got["sha256"]) == (raw, len(raw), hashlib.sha256(raw).hexdigest())
        assert json.loads(got["told"]).get("content_type") == r["content_type"]
    for r in made.collect():
        raw = open(f"{local(root)}/{r['path']}", "rb").read()
        assert hashlib.sha256(raw).hexdigest() == r["sha256"] and r["records"] <= 4
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            assert all(m.mode == 0o600 and m.mtime == 0 and m.name.endswith(".bin") for m in tar)


def rewrite(path, change):
    with tarfile.open(path) as tar:
        members = [(m, tar.extractfile(m).read()) for m in tar]
    with tarfile.open(path, "w:gz") as tar:
        for m, body in change(members):
            m.size = len(body)
            tar.addfile(m, io.BytesIO(body))


def extra(members):
    more = tarfile.TarInfo("further.bin")
    return [*members, (more, b"x")]


@pytest.mark.parametrize("change, said", [(lambda m: [m[1], m[0], *m[2:]], "differ at 'k0"), (lambda m: m[:-1], "ends before 'k0"), (extra, "further.bin"), (lambda m: [(m[0][0], b"other"), *m[1:]], "'k0.*damaged")])
def test_packs_that_are_not_as_indexed_fail_with_the_name(objects, root, change, said):
    made = artifacts.write_packs(objects.where("bucket = 'b' AND length(body) > 0"), root, "bucket", "key", "body", None, 1 << 30, 5)
    rewrite(f"{local(root)}/{made.orderBy('pack').first()['path']}", change)
    with pytest.raises(Exception, match=said):
        artifacts.read_packs(made, root, "bucket").collect()


def test_bodies_with_credentials_are_refused(spark, root):
    bad = spark.createDataFrame([("a", "k", "key AKIA" + "A" * 16)], "bucket string, key string, body string")
    with pytest.raises(Exception, match="credentials"):
        artifacts.write_packs(bad, root, "bucket", "key", "body")


@pytest.fixture
def published(objects, root, tmp_path):
    made = artifacts.write_packs(objects, root, "bucket", "key", "body", None, 300, 4)
    parts = artifacts.artifacts(made, "bucket").withColumn("unit", F.concat_ws("/", F.coalesce("bucket", F.lit("none")), "unit")).drop("bucket")
    units = parts.select("unit").distinct().withColumn("digest", F.sha2("unit", 256))
    store = f"file://{tmp_path}/ledger"
    ledger.publish(units, parts, root, store, "here", "g1")
    return units, parts, store


def test_published_generations_are_loaded(spark, published, root):
    units, parts, store = published
    got_units, got_parts, why = ledger.load(spark, store, "here")
    assert why is None and sorted(map(tuple, got_units.collect())) == sorted(map(tuple, units.collect())) and got_parts.count() == parts.count()
    assert ledger.load(spark, store, "elsewhere") == (None, None, "no_candidate")
    ledger.publish(units.limit(1), parts.limit(2), root, store, "here", "g2")
    assert ledger.load(spark, store, "here")[0].count() == 1
    contents = parts.select("sha256").distinct().count()
    blobs = [f for _, _, names in os.walk(local(store) + "/blobs") for f in names if len(f) == 64]
    assert len(blobs) == contents, "each content once, also after the second capture"
    with open(local(ledger._pointer(store, "here")), "w") as f:
        f.write("../x")
    assert ledger.load(spark, store, "here") == (None, None, "format_changed")


def test_a_failed_publish_leaves_the_pointer(spark, published, root):
    units, parts, store = published
    lost = parts.withColumn("sha256", F.when(F.col("kind") == "data", F.sha2("path", 256)).otherwise(F.col("sha256")))
    with pytest.raises(ledger.LedgerError) as e:
        ledger.publish(units, lost, root, store, "here", "g2")
    assert e.value.reason == "artifact_corrupt"
    gone = parts.withColumn("path", F.concat(F.lit("no/"), "path")).withColumn("sha256", F.sha2("path", 256))
    with pytest.raises(ledger.LedgerError) as e:
        ledger.publish(units, gone, root, store, "here", "g3")
    assert e.value.reason == "artifact_missing"
    odd = parts.withColumn("path", F.concat(F.lit("../"), "path"))
    with pytest.raises(ledger.LedgerError) as e:
        ledger.publish(units, odd, root, store, "here", "g4")
    assert e.value.reason == "artifact_corrupt"
    assert ledger.load(spark, store, "here")[0].count() == units.count()
    assert not [f for _, _, names in os.walk(local(store) + "/blobs") for f in names if "." in f.strip(".")], "no draft stays"


def test_lost_damaged_and_further_blobs(spark, published, tmp_path):
    _, parts, store = published
    rows = parts.where("kind = 'data'").orderBy("unit").collect()
    lost, hurt = rows[0], rows[1]
    os.remove(local(ledger.blob_path(store, lost["sha256"])))
    with open(local(ledger.blob_path(store, hurt["sha256"])), "ab") as f:
        f.write(b"!")
    with files.created(ledger.blob_path(store, "f" * 64)) as f:
        f.write(b"more")
    told = {(r["unit"], r["kind"]): r["problem"] for r in ledger.verified(parts, store).collect()}
    assert told.pop((lost["unit"], "data")) == "artifact_missing" and told.pop((hurt["unit"], "data")) == "artifact_corrupt" and set(told.values()) == {None}
    assert [r["sha256"] for r in ledger.unlisted_blobs(spark, store, parts).collect()] == ["f" * 64]
    fresh = f"file://{tmp_path}/fresh"
    back = {(r["unit"], r["kind"]): r["problem"] for r in ledger.materialised(parts, store, fresh).collect()}
    assert sum(p is None for p in back.values()) == parts.count() - 2
    for r in parts.collect():
        if back[r["unit"], r["kind"]] is None:
            assert files.summed(f"{fresh}/{r['path']}") == (r["sha256"], r["size"])
        else:
            assert not os.path.exists(local(f"{fresh}/{r['path']}"))


def test_checksums_of_odd_names(spark, tmp_path):
    from lodestone.operators import verify

    want = set()
    for name in ("plain", "a b", "50%", "é+#?", "x/y z"):
        with files.created(f"file://{tmp_path}/odd/{name}") as f:
            f.write(name.encode())
        want.add((name, hashlib.sha256(name.encode()).hexdigest(), len(name.encode())))
    assert all(os.path.exists(f"{tmp_path}/odd/{n}") for n, _, _ in want)
    assert {tuple(r) for r in verify.checksums(spark, f"file:{tmp_path}/odd").collect()} == want


def test_small_packs_share_tasks(spark, tmp_path):
    rows = spark.range(40).selectExpr("'r' AS resource", "format_string('%03d', id) AS key", "'body' AS body")
    made = artifacts.write_packs(rows, f"file://{tmp_path}/small", "resource", "key", "body", None, 1000, 1)
    back = artifacts.read_packs(made, f"file://{tmp_path}/small", "resource")
    assert made.count() == 40 == back.where("body = cast('body' AS binary)").count() and back.rdd.getNumPartitions() <= 8
    told = ledger._each(made.select("path", "sha256", "size"), lambda path, sha256, size: None)
    assert told.count() == 40 and told.rdd.getNumPartitions() == 4
