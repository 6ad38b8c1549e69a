"""The pipeline against a brute-force version of each stage, each on its own input."""

import itertools
import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp
from lodestone.llm import domain_mixing, language_id

from .test_ngram_join import brute as classes


def cut_passages(texts, length, words):
    """Each text without its stretches of that many words of bytes that repeated windows cover."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[k : k + length] for raw in raws for k in range(len(raw) - length + 1))
    out = []
    for text, raw in zip(texts, raws):
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept, changed = bytearray(), False
        for flag, part in itertools.groupby(zip(gone, raw), key=lambda x: x[0]):
            piece = bytes(b for _, b in part)
            cut = flag and len(piece.split()) >= words
            changed |= bool(cut)
            kept += b"" if cut else piece
        out.append(kept.decode("utf-8", "ignore") if changed else text)
    return out


def test_passages_of_over_fifty_words_are_cut_and_shorter_ones_stay(spark, sf):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    long, short, clean = [prose(n) for n in (51, 55, 62, 70)], [prose(n) for n in (20, 40)], [prose(200) for _ in range(6)]
    rows = [(k, f"{prose(30)} {p} {prose(30)}") for k, p in enumerate(p for p in long + short for _ in range(3))]
    rows += [(100 + k, t) for k, t in enumerate(clean)]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in cp.repeated_passages(spark, docs, sf).collect()}
    for k, t in rows:
        if k < 3 * len(long):
            assert long[k // 3] not in got[k] and len(got[k].split()) >= 58
        else:
            assert got[k] == t


def test_edges_of_all_stages(spark, sf):
    """Empty tables, nulls in every column and columns whose names the stages use."""
    row = [(1, "the words of a text that stand here", "en", "s", 9, -5.0, 7, 8, "x", True), (None, None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1.0, 1, 1, "y", False)]
    docs = spark.createDataFrame(row, "doc_id long, text string, lang string, source string, n_chars long, score double, row long, _row long, lang_pred string, rejected boolean")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        got = stage(spark, docs, sf)
        rows = got.collect()
        if name == "tokens":
            assert len(rows) == 3
        else:
            assert got.columns == docs.columns
            kept = {r["doc_id"]: r for r in rows}
            assert name == "language" or set(kept) == {1, 2, None}
            assert all(kept[k]["score"] == s and kept[k]["_row"] == w for k, s, w in ((1, -5.0, 8), (2, 1.0, 1)) if k in kept)


def test_stages(spark, sf, tmp_path, tokenizer_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionAll(docs.limit(3)).unionAll(spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "", None, None, None), (900_003, "123 456", "en", "s", 7)], docs.schema))
    for name, stage in cp.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        after_frame = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r.asDict() for r in after_frame.collect()]
        if name == "language":
            judge = language_id.Judge(language_id.learn(docs))
            told = [(r, judge(r["text"])) for r in before]
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, (lang, m) in told if lang != "und" and m >= language_id.MARGIN)
        elif name == "near_duplicates":
            found = classes([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in found.values()})
        elif name == "repeated_passages":
            got = {r["doc_id"]: r["text"] for r in after}
            want = cut_passages([r["text"] for r in before], cp.PASSAGE_BYTES, cp.PASSAGE_WORDS)
            assert [got[r["doc_id"]] for r in before] == want
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        elif name == "mixing":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0 AND quality = 1").collect()}
            assert not gone & clean
            rates = {r["doc_id"]: r["rate"] for r in domain_mixing.mix(docs, domain_mixing.label_toxic(spark.read.parquet(f"{sf}/labels.parquet")), cp.CHANGES, relative=True).collect()}
            assert gone == {d for d, rate in rates.items() if rate < 0.5} and len(toxic) > 0
        else:
            from lodestone.llm import bpe_codec

            own = bpe_codec.codec(str(tokenizer_path("byte_bpe_50k.json")))
            want = {r["doc_id"]: bpe_codec.digest(r["text"] or "", own) for r in before}
            assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after} == want
        if name != cp.STAGES[-1][0]:
            assert after_frame.columns == docs.columns
        docs = after_frame


def test_the_run_is_the_stages(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_unrelated_texts_stay_whatever_their_ids(spark, sf, words):
    apart = [words(30) for _ in range(9)]
    base = words(60)
    rows = [(None, apart[0]), (None, apart[1]), (None, apart[2]), (None, None), (None, ""), (5, apart[3]), (5, apart[4]), (5, apart[5])]
    # Linked texts, and unlinked ones with the ids of either.
    rows += [(9, base), (12, base + " end"), (9, apart[6]), (12, apart[7]), (None, apart[8]), (None, apart[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_duplicates(spark, docs, sf).collect()
    want = set(rows) - {(12, base + " end")}
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
