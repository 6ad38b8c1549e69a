import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import suffix_dedup as sd


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text, by counting every window."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out.append((len(raw), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(length // 3)
    base = prose(length)
    texts = [prose(r.randint(1, length)) for _ in range(12)]
    texts += [texts[0], texts[1] + "x", base, base[: len(base) // 2] + "#" + base[len(base) // 2 :]]
    texts += [prose(r.randint(5, 40)) + passage[r.randint(0, 20) :] + prose(r.randint(5, 40)) for _ in range(30)]
    texts += ["a" * (3 * length), "ab" * length, "a" * (length - 1), "", None, "é" * length]
    texts += [base[:k] + prose(3) + base[k:] for k in range(0, len(base), max(1, len(base) // 25))]
    return texts


def test_suffix_sort_is_a_sort():
    r = np.random.default_rng(3)
    data = r.integers(0, 2, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    starts = np.arange(0, 2900)
    order, equal = sd.suffix_sort(data, starts, 90)
    raw = data.tobytes()
    got = [raw[s : s + 90] for s in starts[order].tolist()]
    assert got == sorted(got)
    assert equal.tolist() == [False] + [a == b for a, b in zip(got, got[1:])]


def test_pieces_of_several_lengths_are_told_apart():
    r = random.Random(5)
    base = "".join(r.choice("ab") for _ in range(60)).encode()
    pieces = [base[: r.randint(16, 60)] if r.random() < 0.5 else bytes(r.choice(b"ab") for _ in range(r.randint(16, 20))) for _ in range(400)]
    cls = sd.equal_pieces(pieces).tolist()
    assert len(set(cls)) == len(set(pieces)) == len(set(zip(cls, pieces)))


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    assert sd.sliding_min(x, 9).tolist() == [min(x[k : k + 9]) for k in range(49)]


def check(spark, texts, length, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in sd.digests(docs, length=length, **how).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, length)


def test_against_all_windows(spark):
    for seed, length in ((1, 60), (2, 400)):
        check(spark, corpus(seed, length), length)


def test_groups_in_many_parts(spark):
    check(spark, corpus(4, 60), 60, part=3)


def test_different_runs_under_one_hash_are_told_apart(spark):
    """With no bit, or few, of the hashes every verdict is left to the comparison of bytes."""
    texts = corpus(6, 60)[:30]
    for bits, part in ((0, 256), (2, 4)):
        check(spark, texts, 60, bits=bits, part=part)


def test_long_texts_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 100)
    h = list(sd.runs_of(b"abc" * 200, 60))
    assert sum(int((last - first + 1).sum()) for first, last, *_ in h) == 541


def test_nulls_repeats_and_clashing_columns(spark):
    long = "word " * 200
    rows = [(1, long, 5), (1, long, 5), (None, None, None), (None, "x", 1), (2, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = sorted(map(tuple, sd.digests(docs).collect()), key=str)
    assert [g[:4] for g in got] == [(1, 1000, 1000, 1), (1, 1000, 1000, 1), (2, 0, 0, 0), (None, 0, 0, 0), (None, 1, 0, 0)]
    assert sd.digests(docs.limit(0)).count() == 0
    for clash in ("n_bytes", "key", "_row", "others", "spans", "lo", "anchor"):
        named = docs.withColumnRenamed("n_bytes", clash)
        cut = sd.deduplicated(named)
        assert cut.schema == named.schema
        assert {(r["doc_id"], r["text"], r[clash]) for r in cut.collect()} == {(1, "", 5), (None, None, None), (None, "x", 1), (2, "", 2)}
    assert sd.deduplicated(docs.limit(0)).count() == 0


def test_stretches_of_few_words_stay(spark):
    few, many = "x" * 500, "word " * 100
    docs = spark.createDataFrame([(k, f"{k} {few} {k} {many}{k}") for k in range(3)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in sd.deduplicated(docs, words=51).collect()}
    assert all(few in t and "word word" not in t for t in got.values())


def test_rows_equal_in_id_and_text_bring_their_spans_once(spark):
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(900))
    frame = spark.createDataFrame([(7, text)] * 2000 + [(8, "short")], "doc_id long, text string").repartition(4)
    rows = frame.select(sd.row_name(F.col("doc_id"), F.col("text")).alias("key"), "text")
    held = sd.with_spans(rows, sd.repeated_spans(rows)).selectExpr("sum(coalesce(size(spans), 0)) n").first()["n"]
    assert held <= 10 * 2000  # a few a row, whatever the number of rows
    got = sd.digests(frame).where("doc_id = 7").select("n_bytes", "n_removed", "n_spans").distinct().collect()
    assert [tuple(r) for r in got] == [(900, 900, 1)]
