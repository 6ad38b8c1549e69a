import hashlib
import random

import pytest

from lodestone.llm import bpe_codec as bc
from lodestone.llm import queries, token_counts

ODD = ["It's <|endoftext|>x<|startoftext|> I'll're naïve İstanbul ǅ", "a b c\x1cd 12ab", "", " ", None, "\n\n  x  \t", "日本語 text 🙂🙂", "é é", "<|endoftext", "don't 's 'S", "x" * 20_000, "ab " * 7000, "​ z"]


def library(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(str(path))


def test_counts_are_the_library_s(spark, sf, tokenizer_path):
    path = str(tokenizer_path("word_bpe_49k.json"))
    t = library(path)
    docs = [(k, x) for k, x in enumerate(ODD)] + [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text").collect()]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(frame, path, chunk_bytes=30_000).collect()}
    for d, x in docs:
        assert got[d] == (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)), x
    assert token_counts.count_tokens(frame.limit(0), path).count() == 0


def test_repeated_and_null_rows(spark, tokenizer_path):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(frame, str(tokenizer_path("word_bpe_49k.json"))).collect()), key=str)
    assert got == [(1, 2), (1, 2), (None, 0), (None, 1)]


def test_ids_are_the_library_s(spark, sf, tokenizer_path):
    path = str(tokenizer_path("byte_bpe_50k.json"))
    t, own = library(path), bc.codec(path)
    texts = [x or "" for x in ODD] + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False) == x
    frame = spark.createDataFrame([(k, x, 1) for k, x in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    for r in bc.digests(frame, path).collect():
        x = ODD[r["doc_id"]] or ""
        ids = t.encode(x, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()
    assert bc.digests(frame.limit(0), path).count() == 0
    assert bc.encode_table(frame, path).where("doc_id = 7").first()["decoded"] == ODD[7]


def test_broken_bytes_decode_as_the_library_does(tokenizer_path):
    path = str(tokenizer_path("byte_bpe_50k.json"))
    t, own = library(path), bc.codec(path)
    r = random.Random(1)
    for _ in range(300):
        ids = [r.randrange(50_257) for _ in range(6)]
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


def random_codec(r):
    letters = [b"a", b"b", b"c"]
    pieces, merges = list(letters), []
    while len(merges) < 25:
        a, b = r.choice(pieces), r.choice(pieces)
        if len(a + b) <= 9 and a + b not in pieces:
            merges.append((a, b))
            pieces.append(a + b)
    return bc.Codec({p: k for k, p in enumerate(pieces)}, merges, {})


def test_the_lookahead_settles_every_token():
    """Over random merge lists: tokens that end a lookahead before the end never change with more text."""
    r = random.Random(3)
    for _ in range(60):
        own = random_codec(r)
        raw = bytes(r.choice(b"abc") for _ in range(own.lookahead + 90))
        whole = own._merge_long([own.first[b] for b in raw])
        ends, at = [], 0
        for i in whole:
            at += len(own.bytes_of[i])
            ends.append(at)
        for cut in range(own.lookahead + 1, len(raw)):
            end = 0
            for k, i in enumerate(own.merge(raw[:cut])):
                end += len(own.bytes_of[i])
                if end > cut - own.lookahead:
                    break
                assert i == whole[k] and end == ends[k]


def test_streams_equal_whole_pre_tokens(tokenizer_path):
    r = random.Random(5)
    for own in [random_codec(r) for _ in range(30)] + [bc.codec(str(tokenizer_path("byte_bpe_50k.json")))]:
        raw = bytes(r.choice(b"abc") for _ in range(6000))
        parts = [raw[k : k + 97] for k in range(0, len(raw), 97)]
        assert [i for ids in own.stream(parts, window=40) for i in ids] == own._merge_long([own.first[b] for b in raw])


def test_the_registered_queries(spark, sf):
    assert queries.op9_token_counts(spark, sf).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert queries.op10_bpe_codec(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_counts_of_a_very_long_text(spark, tokenizer_path):
    path, r = str(tokenizer_path("word_bpe_49k.json")), random.Random(9)
    long = " ".join("".join(r.choice("abcdeé'9") for _ in range(r.randint(1, 12))) for _ in range(150_000))
    frame = spark.createDataFrame([(1, long), (2, "x" * 300_000)], "doc_id long, text string")
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(frame, path).collect()}
    t = library(path)
    assert got == {1: len(t.encode(long, add_special_tokens=False).ids), 2: len(t.encode("x" * 300_000, add_special_tokens=False).ids)}
