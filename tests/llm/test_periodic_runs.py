import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic_runs as pr
from lodestone.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute(words):
    """Every maximal stretch of every period, by comparing words one by one."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcde"), max_size=90))
def test_random_words(words):
    assert pr.runs_of(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdefghi"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_repeated_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    runs = pr.runs_of(words)
    assert runs == brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    assert pr.kept_words(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_many_words():
    r = random.Random(3)
    words = [str(r.randrange(3000)) for _ in range(6000)]
    words[1000:2200] = words[1000:1300] * 4
    words[4000:4100] = ["x"] * 100
    assert pr.runs_of(words) == [(1000, 1200, 300), (4000, 100, 1)]


def rows(result):
    return sorted(map(tuple, result.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_the_query_on_texts(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [expected(d, t) for d, t in docs]
    assert rows(queries.op12_periodic_runs(spark, sf)) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > len(docs) / 50


def test_edges(spark):
    docs = [(None, "a b " * 8), (1, None), (2, ""), (3, " \t\n\x0b"), (4, "x " * 20), (4, "x " * 20), (5, "é é " * 9), (6, "no run here at all")]
    docs += [(k, "p q r s t u v " * 9 + "end") for k in range(100, 140)]
    frame = spark.createDataFrame([(*d, 1, "given") for d in docs], "doc_id long, text string, n_words int, collapsed string")
    found = pr.find(pr.planted(frame))
    assert rows(pr.digests(found)) == sorted((expected(*d) for d in docs), key=str)
    kept = pr.find(frame).where("doc_id = 4").first()
    assert kept["n_words"] == 20 and kept["collapsed"] == "x" and kept["collapsed_given"] == "given" and kept["n_words_given"] == 1
    assert [tuple(r) for r in kept["runs"]] == [(0, 20, 1)]
    assert pr.find(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.find(frame, repeats=1)


def test_a_very_long_text(spark):
    r = random.Random(5)
    words = [str(r.randrange(500)) for _ in range(40_000)]
    words[20_000:28_000] = words[20_000:22_000] * 4
    got = pr.find(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (20_000, 8_000, 2_000) in {tuple(x) for x in got["runs"]}
    assert len(got["collapsed"].split()) == 40_000 - 6_000
