import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle_fingerprints as mf
from lodestone.llm import oracles, queries


def edited(text, donor):
    n = len(text) // 3
    return text[: len(text) - n] + donor[:n]


def test_texts_are_edited_by_the_next(spark):
    docs = [(k * k, "".join(chr(97 + (k * j) % 26) for j in range(k * 3)) + "é𝄞" * (k % 3)) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in mf.compare_with_next(frame).collect()}
    order = sorted(docs, reverse=True)
    for (d, text), (_, nxt) in zip(order, order[1:] + order[:1]):
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited(text, nxt).encode()).hexdigest()


def test_roots_and_branches(spark):
    base = "One line here. And more!\nSecond paragraph.\n\nA section.\nIts end."
    changed = base.replace("Its end", "Its ending")
    row = spark.createDataFrame([(base, changed)], "a string, b string").select(mf.fingerprint(F.col("a")).alias("a"), mf.fingerprint(F.col("b")).alias("b"))
    r = row.select("a", "b", mf.likeness(F.col("a"), F.col("b")).alias("like"), mf.likeness(F.col("a"), F.col("a")).alias("same"), mf.differing_paragraphs(F.col("a"), F.col("b")).alias("where")).first()
    assert r["a"] != r["b"] and 0.7 < r["like"] < 1 and r["same"] == 1 and r["where"] == [3]
    root, sections, paragraphs, _ = r["a"].split(".")
    assert len(root) == 32 and len(sections.split(",")) == 2 and len(paragraphs.split(",")) == 4


def test_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = queries.op8_merkle_fingerprints(spark, sf)
    columns = sorted(result.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.MERKLE})").fetchall()
    assert sorted(tuple(map(str, r)) for r in result.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in want)
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edges(spark):
    rows = [(1, "same text", 0.0), (1, "same text", 0.0), (None, None, 1.0), (2, "", 1.0), (3, "x" * 50_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next double")
    got = mf.compare_with_next(docs).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert {r["fingerprint"] for r in got if r["doc_id"] in (None, 2)} == {got_one["fingerprint"] for got_one in got if got_one["doc_id"] == 2}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert mf.compare_with_next(docs.limit(0)).count() == 0
    alone = mf.compare_with_next(docs.where("doc_id = 3")).first()
    assert alone["near_next"] == 1


def test_only_differing_sections_are_opened(spark):
    sections = [[f"line {s} {k} says {(s * k) % 7}." for k in range(1 + s % 5)] for s in range(40)]
    base = "\n\n".join("\n".join(s) for s in sections)
    sections[7][1] = "A new line."
    sections[20] += [sections[3][0], "Another."]
    sections[33] = []
    changed = "\n\n".join("\n".join(s) for s in sections)
    pairs = [(base, changed), (changed, base), ("", base), (base, ""), ("x. y\n\nz", "z\n\nx. y")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(mf.fingerprint(F.col("a")).alias("a"), mf.fingerprint(F.col("b")).alias("b"))
    for r in rows.select("a", "b", mf.differing_paragraphs(F.col("a"), F.col("b")).alias("where")).collect():
        own, other = ([p[:12] for p in x.split(".")[2].split(",")] for x in (r["a"], r["b"]))
        assert r["where"] == ([] if r["a"][:32] == r["b"][:32] else [k for k, p in enumerate(other) if p not in own])
