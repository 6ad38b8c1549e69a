"""Ranked lexical search over term postings, in whole numbers.

1. ``postings``: tasks cut their documents into slices of about ``SLICE_BYTES``
   of text. Of each slice and term one row is made: bucket of the term, term,
   slice, and the lists of the documents that hold it (number within the slice,
   doc_id, terms in the document, occurrences). A row with a null term lists all
   documents of the slice. So a term that stands in a third of all documents has
   one row a slice, and a row is bounded by its slice.
2. ``search`` joins the items' terms to the postings on bucket and term. Up to
   ``BROADCAST_ROWS`` distinct terms are broadcast (their number is counted
   first); more are dealt over the buckets, each term ``SALTS`` times, so that a
   frequent one meets its slices in several tasks.
3. The postings that are left are written, shuffled by slice, joined to the items
   of their term and scored. As a document lies in one slice, its sum by item
   needs no further shuffle, and each task passes on its best ``k`` an item only
   (the window's limit) before ``row_number`` ranks them.

Scores are 64-bit integers: weight ``floor(1000 ln((2 N + 2) / (2 df + 1)))``
times ``(1e9 tf) div (1000 tf + 8 m)`` with ``m = 10 + (90 n N) div L``. So sums do
not depend on the order of the rows.

Defined results: a null or empty text, or one without a term, is no document
(not in N) and is never found; such an item finds nothing and has no row. Each row
of ``docs`` is a document, so repeated rows and repeated doc_ids count each time.
Equal scores go by ascending doc_id (null first), then by slice and place. Rows with
one item_id are one item with the terms of all its rows, once each. A null item_id is
an item. Very long texts are read whole; a slice holds one at least.
Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SLICE_BYTES = 8 << 20
BUCKETS = 1024
BROADCAST_ROWS = 100_000
SALTS = 16
ROWS_A_BATCH = 20_000

#: What parts terms, and the letters whose case does not count.
NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: By byte: a term's bytes lower-cased, a space for each other one.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))

_SCHEMA = "bucket int, term string, slice long, docs array<struct<place:int,doc_id:bigint,n:int,tf:int>>"


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


class _Slice:
    """The documents of a slice, and how often each term stands in each."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.term_no, self.tf, self.held = [], [], []
        self.doc_ids, self.lengths, self.size = [], [], 0

    def add(self, doc_id: int | None, raw: bytes | None) -> None:
        self.size += len(raw or b"")
        found = Counter((raw or b"").translate(_FOLD).split())
        if found:
            terms = self.terms
            self.term_no += [terms.setdefault(t, len(terms)) for t in found]
            self.tf += found.values()
            self.held.append(len(found))
            self.doc_ids.append(doc_id)
            self.lengths.append(found.total())

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        docs = len(self.doc_ids)
        if not docs:
            return
        term_no = np.array(self.term_no, np.int64)
        order = np.argsort(term_no, kind="stable")
        place = np.repeat(np.arange(docs, dtype=np.int32), self.held)[order]
        tf = np.array(self.tf, np.int32)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(term_no, minlength=len(self.terms)))])
        ids, lengths = pa.array(self.doc_ids, pa.int64()), np.array(self.lengths, np.int32)

        def batch(terms: pa.Array, offsets: np.ndarray, place: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
            held = pa.StructArray.from_arrays([pa.array(place), ids.take(pa.array(place)), pa.array(lengths[place]), pa.array(tf)], ["place", "doc_id", "n", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), held)
            return pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.int32()), terms, pa.array(np.full(len(terms), number)), lists], ["bucket", "term", "slice", "docs"])

        every = np.arange(docs, dtype=np.int32)
        yield batch(pa.nulls(1, pa.string()), np.array([0, docs]), every, lengths)
        names = [t.decode("utf-8", "replace") for t in self.terms]
        for k in range(0, len(names), ROWS_A_BATCH):
            cut = ends[k : k + ROWS_A_BATCH + 1]
            yield batch(pa.array(names[k : k + ROWS_A_BATCH], pa.string()), cut, place[cut[0] : cut[-1]], tf[cut[0] : cut[-1]])


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a slice and term, and one with a null term a slice; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        own, number = _Slice(), itertools.count(first)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own.add(doc_id, raw.as_py())
                if own.size >= SLICE_BYTES:
                    yield from own.rows(next(number))
                    own = _Slice()
        yield from own.rows(next(number))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, _SCHEMA).withColumn("bucket", _bucket(F.col("term")))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, bucket): each item's distinct terms."""
    folded = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    terms = items.select(F.col(key).alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(f"[^{NO_TERM}]+"), F.lit(0))).alias("term"))
    return terms.distinct().withColumn("bucket", _bucket(F.col("term")))


def _joined(rows: DataFrame, facts: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``facts`` by bucket and term joined to postings: broadcast where small, else each fact ``SALTS`` times."""
    on = ["bucket", "term"]
    if small:
        return rows.join(F.broadcast(facts), on, how)
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("slice"), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def search(index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The best ``k`` documents an item: item_id, rank, doc_id, score, slice, place."""
    terms = written(item_terms(items, key, text), "item-terms")
    small = terms.count() <= broadcast_rows
    wanted = terms.select("bucket", "term").distinct().withColumn("_wanted", F.lit(True))
    held = written(_joined(index, wanted, small, "left").where("term IS NULL OR _wanted").select(*index.columns), "postings")

    # Two numbers of the whole corpus, and one row a wanted term.
    sizes = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["n"])
    total = held.where("term IS NULL").agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).cast("long").alias("N"), F.coalesce(F.sum(sizes), F.lit(0)).cast("long").alias("L")).first()
    n_docs, n_terms = total["N"], max(total["L"], 1)
    df = held.where("term IS NOT NULL").groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = terms.join(df.withColumn("w", weight).drop("df"), ["bucket", "term"])

    postings_left = held.where("term IS NOT NULL")
    matches = _joined(postings_left.repartition("slice"), weighed, True) if small else _joined(postings_left, weighed, False).repartition("slice")
    each = matches.select("item_id", "slice", "w", F.explode("docs").alias("d")).select("item_id", "slice", "w", "d.*")
    m = F.expr(f"10 + (90 * cast(n AS bigint) * {n_docs}) div {n_terms}")
    part = F.expr("w * ((1000000000 * cast(tf AS bigint)) div (1000 * cast(tf AS bigint) + 8 * m))")
    scored = each.withColumn("m", m).select("item_id", "slice", "place", "doc_id", part.alias("part"))
    summed = scored.groupBy("slice", "item_id", "place", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc(), "slice", "place")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "slice", "place")
