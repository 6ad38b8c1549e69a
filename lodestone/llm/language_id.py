"""Language identification by compression.

Each language is a raw-content zstandard dictionary of text labelled with it. A
text is folded to lower-case letters and single spaces, cut into blocks of
``BLOCK`` bytes, so that every part of it is judged by the dictionary and not by
what stands before it, and each block is compressed with each dictionary. The
language with the smallest sum wins. A text whose winner is better than the
second by less than ``margin`` (a share of the second's size) is rejected.

The dictionaries come from a bounded sample: of each language the training
documents with the smallest hash, at most ``SAMPLE_DOCS``, whole texts each, as
many as fit into ``DICT_BYTES`` in that order (one that does not fit is passed
over). Of a language whose texts are all longer than that, the text with the
smallest hash teaches by its first ``DICT_BYTES // 4`` characters. Only the
dictionaries travel to the tasks; more than ``MOST_LANGUAGES`` labels are refused.

Defined results: null text, or text without a letter, is ``und`` with score 0
and rejected; very long texts are judged whole, block by block; equal sizes go to
the language with more training text, then to the smaller name; repeated rows
give repeated rows; rows with a null key are never held out nor learnt from;
without any labelled row all is ``und``; other columns are passed on, those named
like an added one as ``<name>_given``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS = 200
DICT_BYTES = 110 << 10
MOST_LANGUAGES = 500
BLOCK = 2048
LEVEL = 6
MARGIN = 0.01
SURE = 0.1

_GAP = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def fold(text: str) -> bytes:
    return _GAP.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """The dictionary of each language, from a bounded sample of the labelled rows."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_key").isNotNull() & ~held_out(F.col("_key")))
    draw = F.xxhash64(F.lit(5), "_key")
    # Most rows are passed over by their hash before any is ranked, so no task ranks a whole language.
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: clean the labels first")
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 4.0 * SAMPLE_DOCS / n))])
    drawn = rows.where(F.pmod(draw, F.lit(1 << 30)) < F.element_at(share, F.col("_lang")) * float(1 << 30))
    order = Window.partitionBy("_lang").orderBy(draw, "_key", "_bytes")
    ranked = drawn.select("_key", "_lang", F.octet_length("_text").alias("_bytes")).where(F.col("_bytes").between(1, DICT_BYTES)).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= SAMPLE_DOCS)
    # At most SAMPLE_DOCS rows of three short values a language: a proven size bound.
    room, fitting = dict.fromkeys(counts, DICT_BYTES), []
    for r in sorted(ranked.collect(), key=lambda r: (r["_lang"], r["_rn"])):
        if r["_bytes"] + 1 <= room[r["_lang"]]:
            room[r["_lang"]] -= r["_bytes"] + 1
            fitting.append((r["_key"], r["_lang"], r["_bytes"], r["_rn"]))
    parts: dict[str, list[bytes]] = {}
    if untaught := sorted(set(counts) - {lang for _, lang, _, _ in fitting}):
        # At most DICT_BYTES of each.
        long = rows.where(F.col("_lang").isin(untaught) & (F.octet_length("_text") > 0))
        first = long.groupBy("_lang").agg(F.min(F.struct(draw.alias("draw"), "_key", F.left("_text", F.lit(DICT_BYTES // 4)).alias("part"))).alias("first"))
        parts = {r["_lang"]: [fold(r["part"])] for r in first.select("_lang", "first.part").collect()}
    schema = T.StructType([drawn.schema["_key"]]).add("_lang", "string").add("_bytes", "integer").add("_rn", "integer")
    chosen = docs.sparkSession.createDataFrame(fitting, schema)
    # At most DICT_BYTES a language; of rows with one key and size the smallest text.
    sample = drawn.withColumn("_bytes", F.octet_length("_text")).join(F.broadcast(chosen), ["_key", "_lang", "_bytes"]).groupBy("_lang", "_rn").agg(F.min("_text").alias("_text"))
    for row in sorted(sample.collect(), key=lambda r: (r["_lang"], r["_rn"])):
        parts.setdefault(row["_lang"], []).append(fold(row["_text"]))
    return {name: b" ".join(p) for name, p in parts.items() if any(p)}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.coders = []
        for name in sorted(dictionaries, key=lambda n: (-len(dictionaries[n]), n)):
            known = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.coders.append((name, coder.compress))

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return [sum(len(compress(b)) for b in blocks) for _, compress in self.coders]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and how much smaller it is than the second, as a share."""
        if not text or not self.coders or not _LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(fold(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=None)
        return self.coders[best][0], 1.0 if second is None else (second - sizes[best]) / max(second, 1)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            got = [judge(t.as_py()) for t in batch.column(text)]
            cols = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([min(1.0, g[1] / SURE) for g in got], pa.float64()), pa.array([g[0] == "und" or g[1] < margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "lang_pred", "score", "rejected"])

    kept = docs.withColumnsRenamed({n: f"{n}_given" for n in ("lang_pred", "score", "rejected")})
    schema = T.StructType(list(kept.schema)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.mapInArrow(run, schema)
