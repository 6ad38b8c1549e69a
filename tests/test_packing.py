"""Packs found in slices against one pass over all records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import packing


def greedy(sizes, max_bytes, max_records=None):
    out, number, held, count = [], 0, 0, 0
    for n in sizes:
        if not count or held + n > max_bytes or max_records is not None and count >= max_records:
            number, held, count = number + 1, 0, 0
        held, count = held + n, count + 1
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_slices_hand_on_what_is_open(seed):
    """The steps of pack() without Spark, over random cuts."""
    r = random.Random(seed)
    sizes = [r.choice([0, 0, 1, r.randint(0, 30), r.randint(50, 130)]) for _ in range(r.randint(1, 120))]
    most, records = r.choice([(100, None), (100, 3), (60, 7), (1000, None), (1 << 40, 5)])
    cuts = sorted({0, len(sizes), *(r.randrange(len(sizes) + 1) for _ in range(r.randint(0, 8)))})
    got, held, count, base = [], 0, 0, 0
    for a, b in zip(cuts, cuts[1:]):
        own = packing._Slice(np.array(sizes[a:b]), most, records)
        sums, open_bytes, open_records, started = own.exits()
        first = own.first(held, count)
        assert first >= own.n or first < len(started) and sums[first] == own.sums[first]
        got += own.numbers(first, base).tolist()
        if first >= own.n:
            held, count = held + int(own.sums[-1]), count + own.n
        else:
            held, count, base = open_bytes[first], open_records[first], base + started[first]
    assert got == greedy(sizes, most, records)


@pytest.mark.parametrize("most, records", [(4000, None), (4000, 7), (1 << 50, 40), (10, None)])
def test_pack_in_many_slices(spark, most, records):
    r = random.Random(most)
    rows = [(None if k % 3 == 0 else "ab"[k % 2], k // 2 if k % 2 else None if k == 0 else -k, r.choice([None, 0, r.randint(0, 900), 5000 if k % 91 == 0 else 3])) for k in range(3000)]
    frame = spark.createDataFrame(rows, "who string, at long, size long").repartition(5)
    got = packing.pack(frame, "who", ["at"], "size", most, records, slice_rows=150).collect()
    by = {}
    for row in got:
        by.setdefault(row["who"], []).append(row)
    assert len(got) == len(rows) and set(by) == {None, "a", "b"}
    for who, found in by.items():
        found.sort(key=lambda x: (x["at"] is not None, x["at"] or 0))
        assert [x["pack"] for x in found] == greedy([x["size"] or 0 for x in found], most, records)


def test_one_hot_resource_is_spread(spark):
    """One source of all rows: no task of the numbering has more than its slice."""
    frame = spark.range(40_000).selectExpr("'only' AS who", "id", "id % 100 AS size")
    packed = packing.pack(frame, "who", ["id"], "size", 1000, slice_rows=2000)
    assert packed.select("pack").distinct().count() == max(greedy([k % 100 for k in range(40_000)], 1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = packing.pack(frame, "who", ["id"], "size", 1000, slice_rows=2000)
        sizes = packed.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and max(sizes) <= 24_000


def test_carried_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 6, None)], "who string, at long, size int, text string")
    got = packing.pack(frame, "who", ["at"], "size", 10, carried=["text"])
    assert got.columns == ["who", "at", "size", "text", "pack"] and sorted(map(tuple, got.collect())) == [("a", 1, 5, "x", 1), ("a", 2, 6, None, 2)]
    assert packing.pack(frame.limit(0), "who", ["at"], "size", 10).count() == 0


def test_slices_of_carried_columns_are_small(spark, monkeypatch):
    seen = []
    keep = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: seen.append((name, df.rdd.getNumPartitions())) or keep(df, name))
    rows = spark.range(48).selectExpr("'r' AS resource", "id", "1 << 20 AS size", "'body' AS body")
    assert packing.pack(rows, "resource", ["id"], "size", 4 << 20, carried=["body"]).agg(F.max("pack")).first()[0] == 12
    assert dict(seen)["slices"] == 4
