"""Greedy packing of ordered records into chunks, in parallel slices.

A chunk takes records until the next one would not fit, so where it ends depends on
where it starts. Of a slice of the order all that matters is what is open when it
begins: the bytes and records of the chunk that reaches into it. That decides which
record of the slice starts the first new chunk, and from there on the slice can say
by itself what will be open at its end. So:

1. Records are dealt into slices of the order (range partitions) and written once.
2. Each slice finds, for every record, the record that starts the next chunk
   (binary search on running sums), follows these from the last record to the first,
   and tells for each record that can start its first new chunk what is open at its
   end: one row a slice, of as many numbers as its first chunk has records.
3. One pass over these rows, in order, hands on what is open: the only sequential
   step, over summaries.
4. Each slice numbers its records from there.

A slice holds about ``SLICE_ROWS`` records, or ``SLICE_BYTES`` where other columns
are carried; records equal in resource and order share one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

# The limits of a chunk and of a pack.
CHUNK_BYTES = 64 << 20
PACK_BYTES = 256 << 20
PACK_OBJECTS = 10_000
SLICE_ROWS = 200_000
SLICE_BYTES = 16 << 20


class _Slice:
    """A slice's records, as sizes in order."""

    def __init__(self, sizes: np.ndarray, max_bytes: int, max_records: int | None):
        self.n, self.max_bytes, self.max_records = len(sizes), max_bytes, max_records
        self.sums = np.concatenate([[0], np.cumsum(sizes)])
        fits = np.searchsorted(self.sums, self.sums[:-1] + max_bytes, "right") - 1
        self.next = np.maximum(fits, np.arange(1, self.n + 1))
        if max_records is not None:
            self.next = np.minimum(self.next, np.arange(self.n) + max_records)

    def first(self, held: int, count: int) -> int:
        """The record that starts the first new chunk, if ``count`` records of ``held`` bytes are open; n if none does."""
        if not count:
            return 0
        at = max(0, int(np.searchsorted(self.sums, self.max_bytes - held, "right")) - 1)
        return at if self.max_records is None else min(at, max(self.max_records - count, 0))

    def exits(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """For each record that can start the first new chunk: running sum before it, bytes and records open at the end, chunks started."""
        lead = min(int(self.next[0]), self.n - 1) + 1
        following = self.next.tolist()
        last, started = list(range(self.n)), [1] * self.n
        for i in range(self.n - 1, -1, -1):
            if following[i] < self.n:
                last[i], started[i] = last[following[i]], started[following[i]] + 1
        ends = np.array(last[:lead])
        return self.sums[: lead + 1].tolist(), (self.sums[-1] - self.sums[ends]).tolist(), (self.n - ends).tolist(), started[:lead]

    def numbers(self, first: int, base: int) -> np.ndarray:
        starts = np.zeros(self.n, np.int64)
        at = first
        while at < self.n:
            starts[at] = 1
            at = int(self.next[at])
        return base + np.cumsum(starts)


def _sorted(table: pa.Table, order: list[str], size: str) -> pa.Table:
    return table.take(pc.sort_indices(table, [(c, "ascending") for c in [*order, size]], null_placement="at_start"))


def _sizes(table: pa.Table, size: str) -> np.ndarray:
    return pc.fill_null(table.column(size), 0).to_numpy().astype(np.int64)


def pack(rows: DataFrame, resource: str, order: list[str], size: str, max_bytes: int, max_records: int | None = None, name: str = "pack", carried: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(resource, order..., size, carried..., pack): packs count from 1; a record over the limit sits alone.

    A null size counts 0. ``carried`` are further columns to keep.
    """
    narrow = rows.select(resource, *order, F.col(size).cast("bigint").alias(size), *(carried or []))
    held = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    parts = 1 + max(held["n"] // slice_rows, held["bytes"] // SLICE_BYTES if carried else 0)
    sliced = written(narrow.repartitionByRange(parts, resource, *order).withColumn("_slice", F.spark_partition_id()), "slices")

    def summed(table: pa.Table) -> pa.Table:
        own = _Slice(_sizes(_sorted(table, order, size), size), max_bytes, max_records)
        sums, open_bytes, open_records, started = own.exits()
        numbers = [[own.n], [int(own.sums[-1])], *([v] for v in (sums, open_bytes, open_records, started))]
        kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 4
        return pa.Table.from_arrays([table.column(resource).slice(0, 1), table.column("_slice").slice(0, 1), *map(pa.array, numbers, kinds)], told.names)

    of = sliced.schema[resource]
    told = T.StructType([of]).add("_slice", "integer").add("n", "long").add("total", "long")
    for c in ("sums", "open_bytes", "open_records", "started"):
        told = told.add(c, T.ArrayType(T.LongType()))
    summaries = sliced.select(resource, *order, size, "_slice").groupBy(resource, "_slice").applyInArrow(summed, told)

    def handed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = object()
        who, open_bytes, open_records, base = fresh, 0, 0, 0
        for batch in batches:
            firsts, bases = [], []
            for row in batch.to_pylist():
                if who is fresh or row[resource] != who:
                    who, open_bytes, open_records, base = row[resource], 0, 0, 0
                first = 0
                if open_records:
                    first = max(0, int(np.searchsorted(row["sums"], max_bytes - open_bytes, "right")) - 1)
                    first = first if max_records is None else min(first, max(max_records - open_records, 0))
                firsts.append(min(first, row["n"]))
                bases.append(base)
                if first >= row["n"]:
                    open_bytes, open_records = open_bytes + row["total"], open_records + row["n"]
                else:
                    open_bytes, open_records, base = row["open_bytes"][first], row["open_records"][first], base + row["started"][first]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.int64()), pa.array(bases, pa.int64())], [resource, "_slice", "_first", "_base"])

    entries = summaries.repartition(resource).sortWithinPartitions(resource, "_slice").mapInArrow(handed_on, T.StructType([of]).add("_slice", "integer").add("_first", "long").add("_base", "long"))
    entries = written(entries, "slice-entries")

    def numbered(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _sorted(left, order, size)
        own = _Slice(_sizes(table, size), max_bytes, max_records)
        numbers = own.numbers(right.column("_first")[0].as_py(), right.column("_base")[0].as_py())
        return table.drop_columns(["_slice"]).append_column(name, pa.array(numbers, pa.int64()))

    out = T.StructType([*narrow.schema.fields, T.StructField(name, T.LongType())])
    return sliced.groupBy(resource, "_slice").cogroup(entries.groupBy(resource, "_slice")).applyInArrow(numbered, out)


def chunk_totals(packed: DataFrame, resource: str, size: str, name: str = "pack") -> DataFrame:
    return packed.groupBy(resource, name).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))
