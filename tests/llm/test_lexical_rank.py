import math
import re
from collections import Counter

import pytest

from lodestone.llm import lexical_rank as lr
from lodestone.llm import oracles, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = {}
    for item, terms in asked.items():
        scores = []
        for doc, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        if scores:
            out[item] = [(r + 1, doc if there else None, -s) for r, (s, there, doc) in enumerate(sorted(scores)[:k])]
    return out


def collect(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_against_brute_force(spark, words, monkeypatch, broadcast_rows):
    monkeypatch.setattr(lr, "SLICE_BYTES", 700)
    docs = [(k, words(3 + k % 40)) for k in range(200)] + [(500, ""), (501, None), (502, "!? -- \t"), (None, words(12)), (7, words(5))]
    docs += [(900, "Straße ÉTÉ kK été. x1_y2")] * 3
    items = [(k, words(6)) for k in range(12)] + [(50, None), (51, "..."), (52, "zzzzzzzzzz"), (None, "STRASSE Straße été"), (3, "K X1 y2 y2"), (60, words(200))]
    d, i = frames(spark, docs, items)
    assert collect(lr.search(lr.postings(d), i, 10, broadcast_rows=broadcast_rows)) == brute(docs, items, 10)


def test_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = queries.op13_lexical_rank(spark, sf)
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({oracles.LEXICAL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(want) > 100


def test_a_term_of_all_documents_is_one_row_a_slice(spark, monkeypatch):
    monkeypatch.setattr(lr, "SLICE_BYTES", 2000)
    docs, items = frames(spark, [(k % 50, "hot words here and there") for k in range(3000)], [(1, "hot"), (2, "cold")])
    index = lr.postings(docs)
    rows = index.where("term = 'hot'").selectExpr("size(docs) n").collect()
    assert sum(r["n"] for r in rows) == 3000 and max(r["n"] for r in rows) < 100
    got = collect(lr.search(index, items, 10))
    assert set(got) <= {1} and all(d == 0 for _, d, _ in got.get(1, []))


def test_very_long_texts_and_clashing_columns(spark, words):
    long = " ".join(words(5000) for _ in range(4))
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, words(30), 6, None), (2, words(30), 6, None)], "doc_id long, text string, score int, term string")
    items = spark.createDataFrame([(1, long[-300:], 1)], "item_id long, text string, rank int")
    plain = [tuple(r)[:2] for r in docs.collect()]
    assert collect(lr.search(lr.postings(docs), items, 10)) == brute(plain, [(1, long[-300:])], 10)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert lr.search(lr.postings(docs.limit(0)), items).count() == 0
    assert lr.search(lr.postings(docs), items.limit(0)).count() == 0
