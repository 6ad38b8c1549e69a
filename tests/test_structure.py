"""Pruning, settings, the account pin, levels and numbers against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, ordering, structure

NAMES = ["a", "b", "", ":null", "x,y", "{", 'q"', "\\", "0", "é"]
LEAVES = [None, "", 0, 0.0, -0.0, False, True, 1, "0", "null", "{}", '","', ":null,", '"a":null', "x{,", [], {}, 10, 0.5, "\\", '\\"']


def made(r, depth):
    kind = r.random()
    if depth and kind < 0.45:
        return {n: made(r, depth - 1) for n in r.sample(NAMES, r.randint(0, 4))}
    if depth and kind < 0.65:
        return [made(r, depth - 1) for _ in range(r.randint(0, 3))]
    return r.choice(LEAVES)


def pruned(v):
    if isinstance(v, dict):
        return {k: c for k, c in ((k, pruned(c)) for k, c in v.items()) if c is not None and c != "" and c != [] and c != {} and (isinstance(c, bool) or c != 0)}
    return [pruned(c) for c in v] if isinstance(v, list) else v


def test_pruning(spark):
    r = random.Random(8)
    values = [{n: made(r, 4) for n in r.sample(NAMES, 5)} for _ in range(400)] + [{}, {"a": {"b": {"c": {"d": {"e": [], "f": 0}}}}}, {"a": [[{"x": ""}]]}]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "id long, t string")
    for row in rows.select("id", structure.pruned(F.col("t")).alias("t")).collect():
        assert json.loads(row["t"]) == pruned(values[row["id"]]), values[row["id"]]
    odd = spark.createDataFrame([("not json",), (None,), ("[]",), ('"x"',), ("0",)], "t string").select(structure.pruned(F.col("t")).alias("t"))
    assert [r["t"] for r in odd.collect()] == [None, None, "[]", '"x"', "0"]


def test_a_cancelled_read_fails(spark):
    reads = spark.createDataFrame([("b", "cors", None, "Canceled")], "bucket string, setting string, value string, error_code string")
    with pytest.raises(Exception, match="cancelled"):
        structure.settings(reads, "bucket")[0].collect()


def test_another_account_fails(spark):
    rows = spark.createDataFrame([("1" * 12,), (None,)], "account string")
    for row in ("1" * 12, "2" * 12):
        with pytest.raises(Exception, match="source_account_mismatch"):
            structure.pinned(rows, "account", row).collect()
    assert structure.pinned(rows, "account", "").count() == 2
    assert structure.pinned(rows.limit(1), "account", "1" * 12).count() == 1


def longest(nodes, edges):
    needs = {n: {v for u, v in edges if u == n and v in nodes} for n in nodes}
    level = {}
    while more := [n for n in nodes if n not in level and all(v in level for v in needs[n])]:
        for n in more:
            level[n] = max((level[v] + 1 for v in needs[n]), default=0)
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = list(range(40))
    edges = [(u, v) for u in nodes for v in nodes if u > v and r.random() < 0.06] + [(100, 1), (1, 100)]
    if seed % 2:
        edges += [(5, 20), (20, 5), (7, 7), (11, 30), (30, 12), (12, 11)]
    got = graph.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "node long, needs long"))
    assert {x["node"]: x["level"] for x in got.collect()} == longest(nodes, edges)


def test_a_long_chain_takes_few_rounds(spark):
    n = 1000
    nodes, edges = spark.range(n).toDF("node"), spark.range(1, n).selectExpr("id AS node", "id - 1 AS needs")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {r["node"]: r["level"] for r in graph.levels(nodes, edges).collect()}
    assert got == {k: k for k in range(n)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 250, "not a round a node"


@pytest.mark.parametrize("within", [None, ["g"]])
def test_numbers_and_sums(spark, within):
    r = random.Random(3)
    rows = [(r.choice("ab") if k % 4 else None, r.choice([None, r.randint(0, 30)]), f"k{k:04d}", r.randint(-5, 9)) for k in range(2500)]
    frame = spark.createDataFrame(rows, "g string, a long, b string, v long").repartition(5)
    got = ordering.numbered(frame, ["a", "b"], within=within, total="v", slices=7).collect()
    groups = {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        groups.setdefault(row[0] if within else None, []).append(row)
    want = set()
    for group in groups.values():
        total = 0
        for n, row in enumerate(group):
            total += row[3]
            want.add((*row, n + 1, total))
    assert len(got) == len(rows) and {(x["g"], x["a"], x["b"], x["v"], x["rn"], x["running"]) for x in got} == want
    assert ordering.numbered(frame.limit(0), ["a"]).count() == 0


def test_the_row_before_of_a_hot_group(spark):
    r = random.Random(5)
    rows = [("hot" if k % 3 else r.choice(["a", "b", None]), k, r.choice([None, k])) for k in range(1500)]
    frame = spark.createDataFrame(rows, "g string, a long, v long").repartition(5)
    got = {(x["g"], x["a"]): x["p"] for x in ordering.with_before(frame, ["a"], ["g"], "v", "p", slices=9).collect()}
    last, want = {}, {}
    for g, a, v in rows:
        want[g, a] = last.get(g)
        last[g] = v
    assert got == want


def test_pruning_reads_a_text_once(spark):
    rows = spark.createDataFrame([('{"a":{"b":null},"c":1}',), ("no json",), (None,)], "t string").select(structure.pruned(F.col("t")).alias("p"))
    assert str(structure.pruned(F.col("t"))).count("parse_json(") == 1
    assert [r["p"] for r in rows.collect()] == ['{"c":1}', None, None]
