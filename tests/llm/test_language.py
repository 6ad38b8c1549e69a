import zlib

import pytest

from lodestone.llm import language_id as li
from lodestone.llm import queries


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in truth.values() or r["lang_pred"] == "und")
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_held_out_rows_teach_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(li.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert li.learn(docs) == li.learn(spoiled)


def test_against_the_library_by_hand(spark, sf):
    """Sizes from zstandard's own calls, on whole texts cut in blocks."""
    import re

    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dictionaries = li.learn(docs)
    coders = {n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=6, write_content_size=False, write_checksum=False, write_dict_id=False) for n, d in dictionaries.items()}
    order = sorted(dictionaries, key=lambda n: (-len(dictionaries[n]), n))
    for r in li.identify(docs, dictionaries).collect():
        flat = re.sub(r"[\W\d_]+", " ", (r["text"] or "").lower()).strip().encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
            continue
        sizes = [sum(len(coders[n].compress(flat[k : k + 2048])) for k in range(0, len(flat), 2048)) for n in order]
        first, second = sorted(sizes)[:2]
        assert r["lang_pred"] == order[sizes.index(first)]
        assert r["rejected"] == ((second - first) / max(second, 1) < li.MARGIN)


def test_dictionaries_hold_whole_texts(spark):
    rows = [(k, chr(97 + k % 26) * 3 + " " + (chr(98 + k // 26) * 2 + " ") * (10 + 500 * (k % 5)), "aa") for k in range(400)]
    got = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["aa"].decode()
    assert len(got) <= li.DICT_BYTES
    pieces = {li.fold(t).decode() for _, t, _ in rows}
    assert pieces and len({p for p in pieces if p in got}) > 5


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two", -5.0, "x", True)], "doc_id long, text string, score double, lang_pred string, rejected boolean")
    row = li.identify(docs, {"aa": b"one two three"}).first()
    assert (row["score_given"], row["lang_pred_given"], row["rejected_given"]) == (-5.0, "x", True) and row["lang_pred"] == "aa"


def test_edges(spark):
    text = {"aa": "one two three four five six " * 30, "bb": "uno dos tres cuatro cinco seis " * 30}
    rows = [(k, text[n], n) for k, n in enumerate(["aa", "bb"] * 10)]
    dictionaries = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(dictionaries) == {"aa", "bb"}
    asked = [(1, "cinco seis uno", 9.0), (2, None, 1.0), (3, "123 !!", 1.0), (4, "", 1.0), (5, "TWO THREE four", 1.0), (5, "TWO THREE four", 1.0), (None, "tres" * 5000, 1.0)]
    got = li.identify(spark.createDataFrame(asked, "doc_id long, text string, score double"), dictionaries).collect()
    assert [r["lang_pred"] for r in got] == ["bb", "und", "und", "und", "aa", "aa", "bb"]
    assert [r["rejected"] for r in got[1:4]] == [True] * 3
    none = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert li.learn(none) == {} and li.identify(none, {}).first()["lang_pred"] == "und"
    assert li.identify(none.limit(0), dictionaries).count() == 0


def test_a_language_of_long_texts_only_is_learnt(spark):
    en, fr = "the cat and the dog of the house ", "le chat et le chien de la maison "
    rows = [(k, en * 20, "en") for k in range(30)] + [(100 + k, fr * 8000, "fr") for k in range(6)]
    known = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(known) == {"en", "fr"} and 0 < len(known["fr"]) <= li.DICT_BYTES
    told = li.identify(spark.createDataFrame([(1, fr * 5), (2, en * 5)], "doc_id long, text string"), known).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in told} == {1: "fr", 2: "en"}


def test_dirty_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_LANGUAGES", 5)
    with pytest.raises(ValueError):
        li.learn(spark.createDataFrame([(k, "some text", f"l{k}") for k in range(40)], "doc_id long, text string, lang string"))
