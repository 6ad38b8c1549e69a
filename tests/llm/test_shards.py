import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm import stratified_shards as ss


def test_the_law_of_rows_and_the_mixture(spark):
    docs = [(k, "t" * (k % 50), "big" if k % 3 else f"s{k % 4}") for k in range(1003)] + [(5000, None, None), (5001, "é", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = ss.interleave(frame, shards=7, buckets=16).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(docs)))
    per = Counter(r["shard"] for r in rows)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    text = {k: t for k, t, _ in docs}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    # Every stretch of the order holds each source within one or two rows of its part.
    total = Counter(r["source"] for r in rows)
    seen = defaultdict(int)
    for n, r in enumerate(sorted(rows, key=lambda r: r["position"]), 1):
        seen[r["source"]] += 1
        for source, t in total.items():
            assert abs(seen[source] - n * t / len(rows)) <= 3
    again = {r["doc_id"]: r["position"] for r in ss.interleave(frame.repartition(2), shards=7, buckets=16).collect()}
    assert again == {r["doc_id"]: r["position"] for r in rows}


def test_order_is_that_of_fractional_ranks(spark):
    docs = [(k, "x", f"s{min(k % 10, 3)}") for k in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = sorted(ss.interleave(frame, shards=3, buckets=8).collect(), key=lambda r: r["position"])
    total, at, ranks = Counter(s for _, _, s in docs), Counter(), []
    for r in rows:
        at[r["source"]] += 1
        ranks.append((2 * at[r["source"]] - 1) / total[r["source"]])
    assert ranks == sorted(ranks)


def test_edges(spark, sf):
    rows = spark.createDataFrame([(1, "a", "s", 3)] * 5 + [(None, None, None, 1)], "doc_id long, text string, source string, shard int")
    got = ss.interleave(rows, shards=4).collect()
    assert len(got) == 6 and sorted(r["position"] for r in got) == list(range(6))
    assert ss.interleave(rows.limit(0)).count() == 0
    got = queries.op6_stratified_interleave(spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    n = Counter(r["shard"] for r in got.collect())
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 40


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op6_stratified_interleave(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute(rows, shards, seed, buckets):
    """Every row's shard and slot, straight from the definition: (key, source, text, draw) in."""
    lanes = {}
    for key, source, text, draw in rows:
        raw = (text or "").encode()
        crc = zlib.crc32(raw) if text is not None else 0
        lanes.setdefault("" if source is None else f"={source}", []).append((draw % buckets, draw, key is not None, key or 0, crc, len(raw) + 16))
    placed = []
    for lane, own in lanes.items():
        n = len(own)
        for r, (*_, there, key, crc, size) in enumerate(sorted(own), 1):
            placed.append((((2 * r - 1) * buckets) // (2 * n), r * 2.0 / n - 1.0 / n, lane, r, key if there else None, crc, size))
    total, out = len(placed), []
    for at, (*_, key, crc, size) in enumerate(sorted(placed)):
        shard = at * shards // total
        out.append((key, size, crc, shard, at - (shard * total + shards - 1) // shards))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(12)
    rows = [(k if k % 50 else None, r.choice(["a", "a", "a", "b", "c", None]), "word " * (k % 13) if k % 17 else None) for k in range(900)] + [(5000 + k, "hot", "the same text") for k in range(400)]
    rows += [(7, "a", "twice")] * 3 + [(9999, "b", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    drawn = frame.select("doc_id", "source", "text", F.xxhash64(F.lit(17), "doc_id")).collect()
    for shards, buckets in ((40, 4096), (7, 16)):
        got = ss.interleave(frame, shards=shards, buckets=buckets).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert sorted(map(tuple, got), key=str) == brute(drawn, shards, 17, buckets)
