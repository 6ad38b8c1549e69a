"""Exact substring deduplication by a hash-compared suffix sort.

A byte is removed if some string of ``length`` bytes that covers it also starts at
another place of the table, in this document or another. A sort of all suffixes
of the table would find them; this one sorts only those that can matter, and
sorts them in parallel.

1. ``runs``: each window (string of ``length`` bytes) has an anchor, the k-gram
   in it with the smallest polynomial hash, the leftmost of equals. Consecutive
   windows with one anchor form a run. Equal windows have equal anchors at equal
   offsets, so windows need comparing only among runs with the same anchor.
2. Candidates, by hashes: runs that may be equal as a whole; and, among different
   runs with one anchor of which one occurs once, those that share the half of
   the spare bytes to the left or to the right of the anchor, as every window
   reaches over one of them. Hashes only choose what is sorted together.
3. The sort. The bytes of candidates are shuffled by group and mergesorted: runs
   of the first kind each as one suffix, of the second kind every window in them.
   A comparison finds the common extension of two suffixes by binary search over
   prefix polynomial hashes, in a logarithmic number of steps; neighbours that
   seem equal are compared byte by byte. Equal runs, or windows, are repeated.
4. Groups of any size are dealt in parts of about ``PART``. Each part is sorted by
   itself; then one of each content goes on, by rounds, until all of a group were
   in one part. Windows that no partner in their part settled go on under a hash
   of their bytes, and are sorted and compared in the same way.
5. Where different runs had one hash, all windows of the runs with their anchors
   go through step 4's last sentence, so a collision neither adds nor loses any.
6. The repeated stretches are gathered per document and joined to its text.

No window is held to be repeated before its bytes were compared. A row is named
by the 128-bit digest of its id and text.

Defined results: null text counts as empty; texts shorter than ``length`` keep
everything; very long texts are read in chunks and judged whole; repeated rows
repeat each other; ties do not arise; a null doc_id stays null; an empty table
gives no rows; ``digests`` ignores other columns and ``deduplicated`` keeps them,
whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import letters, mixed
from .shared import freed, row_name, spread_join, written

LENGTH = 400
PART = 256
CHUNK = 1 << 18
SORTED_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


@functools.lru_cache(maxsize=4)
def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = np.uint64(pow(int(BASE), -1, 1 << 64)) if inverse else BASE
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(1 << max(19, (n - 1).bit_length()), inverse)[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """H[i] = sum of letter[j] * BASE**j over j < i, in 64 bits."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters()[raw] * powers(len(raw)), out=out[1:])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by running minima of blocks."""
    n, pad = len(x), -len(x) % width
    blocks = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, last start, anchor place, anchor hash, left and right hash) arrays, chunk by chunk."""
    k = length // 4
    half = (length - k) // 2
    for base in range(0, len(raw) - length + 1, CHUNK):
        data = np.frombuffer(raw, np.uint8)[base : base + CHUNK + length - 1]
        h = prefix_hashes(data)
        back = powers(len(h), inverse=True)
        grams = mixed((h[k:] - h[:-k]) * back[: len(h) - k])
        least = sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        p = at[first]
        lo, hi = np.maximum(p - half, 0), np.minimum(p + k + half, len(data))
        left = np.where(p - first >= half, mixed((h[p + k] - h[lo]) * back[lo]), np.uint64(0))
        right = np.where(p - last < half, mixed((h[hi] - h[p]) * back[p] + np.uint64(1)), np.uint64(0))
        yield first + base, last + base, p + base, grams[p], left, right


def pack(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (first << 24) | ((last - first) << 12) | (anchor - first)


def _runs(length: int, bits: int):
    """(key, text) rows in; a row a run out. ``bits`` of the hash of a run's bytes are used."""
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[np.ndarray, ...]] = []
            size = 0
            for row, raw in enumerate(raw_texts(batch.column(1))):
                if len(raw) < length:
                    continue
                for first, last, p, anchor, left, right in runs_of(raw, length):
                    whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + length]) & mask for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                    kept.append((anchor, whole, np.full(len(first), row), pack(first, last, p), left, right))
                    size += len(first)
                if size > 50_000:
                    yield _batch(kept, batch.column(0))
                    kept, size = [], 0
            if kept:
                yield _batch(kept, batch.column(0))

    return run


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a column, one at a time; null is empty."""
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def _batch(kept: list[tuple[np.ndarray, ...]], keys: pa.Array) -> pa.RecordBatch:
    anchor, whole, row, pos, left, right = (np.concatenate(c) for c in zip(*kept))
    cols = [pa.array(c.view(np.int64)) for c in (anchor, whole, pos, left, right)]
    return pa.RecordBatch.from_arrays([*cols[:2], keys.take(pa.array(row)), *cols[2:]], ["anchor", "whole", "key", "pos", "left", "right"])


def common_extension(h: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to ``most``: binary search."""
    lo, hi = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64) + most
    ha, hb, pa_, pb = h[a], h[b], power[a], power[b]
    while len(lo) and int((hi - lo).max()) > 0:
        mid = (lo + hi + 1) >> 1
        same = (h[a + mid] - ha) * pb == (h[b + mid] - hb) * pa_
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(data: np.ndarray, starts: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first ``length`` bytes (one number, or one a suffix), and which equal the one before.

    The first 8 bytes, which all suffixes have, split them into segments; each is
    mergesorted, all at once, with comparisons by common extension. Equality is
    checked on bytes.
    """
    h, power = prefix_hashes(data), powers(len(data) + 1)
    lengths = np.zeros(len(starts), np.int64) + length
    eight = np.zeros(len(starts), np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | data[starts + j]
    order = np.argsort(eight, kind="stable")
    eight = eight[order]
    n = len(starts)
    begin = np.flatnonzero(np.concatenate([[True], eight[1:] != eight[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begin, [n]]))
    segment, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - segment

    def compare(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b, la, lb = starts[i], starts[j], lengths[i], lengths[j]
        most = np.minimum(la, lb)
        same = common_extension(h, power, a, b, most)
        at = np.minimum(same, most - 1)
        return np.where(same >= most, np.sign(la - lb), np.sign(data[a + at].astype(np.int16) - data[b + at].astype(np.int16)))

    width = 1
    while n and width < int(sizes.max()):
        own = local // width
        other = (own ^ 1) * width
        active = np.flatnonzero(other < size)
        is_left = (own[active] & 1) == 0
        lo, hi = np.zeros(len(active), np.int64), np.minimum(width, size[active] - other[active])
        base = segment[active] + other[active]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            c = compare(order[base[open_] + mid], order[active[open_]])
            before = np.where(is_left[open_], c < 0, c <= 0)
            lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
        to = np.arange(n)
        to[active] = segment[active] + (own[active] & ~1) * width + local[active] % width + lo
        merged = np.empty_like(order)
        merged[to] = order
        order, width = merged, width * 2
    equal = np.zeros(n, bool)
    pairs = np.flatnonzero(local > 0)
    if len(pairs):
        x, y = order[pairs - 1], order[pairs]
        pairs = pairs[(lengths[x] == lengths[y]) & (common_extension(h, power, starts[x], starts[y], np.minimum(lengths[x], lengths[y])) >= lengths[x])]
    flat = memoryview(data)
    for k, a, b, m in zip(pairs.tolist(), starts[order[pairs - 1]].tolist(), starts[order[pairs]].tolist(), lengths[order[pairs]].tolist()):
        equal[k] = flat[a : a + m] == flat[b : b + m]
    return order, equal


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each piece begins)"""
    ends = np.cumsum([len(p) for p in pieces])
    return np.frombuffer(b"".join(pieces), np.uint8), ends - [len(p) for p in pieces]


def equal_pieces(pieces: list[bytes]) -> np.ndarray:
    """A number for each piece, the same for equal ones."""
    data, begins = joined(pieces)
    order, equal = suffix_sort(data, begins, np.array([len(p) for p in pieces]))
    out = np.empty(len(pieces), np.int64)
    out[order] = np.cumsum(~equal) - 1
    return out


def window_classes(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the pieces: its piece, its place there, whether it starts elsewhere too, whether it is the first of its kind."""
    data, begins = joined(pieces)
    n = np.array([len(p) - length + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), n)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    order, equal = suffix_sort(data, begins[piece] + place, length)
    twice, first = np.empty(len(order), bool), np.empty(len(order), bool)
    twice[order], first[order] = equal | np.concatenate([equal[1:], [False]]), ~equal
    return piece, place, twice, first


def stretches(places: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last) of consecutive places of a piece; sorted by both."""
    cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(piece) != 0))
    a, b = np.concatenate([[0], cut + 1]).astype(int), np.concatenate([cut, [len(places) - 1]]).astype(int)
    return (piece[a], places[a], places[b]) if len(places) else (piece, places, places)


_ITEM = "kind int, grp long, more boolean, part int, once boolean, first long, n long"


def _fetch(length: int):
    """(key, text, items) rows in; each item with its bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten()
            fields = [flat.field(k) for k in range(7)]
            firsts, ns = fields[5].to_pylist(), fields[6].to_pylist()
            at, done, size = 0, 0, 0
            rows, out = [], []
            for row, raw in enumerate(raw_texts(batch.column(1))):
                for at in range(at, at + int(counts[row])):
                    out.append(raw[firsts[at] : firsts[at] + ns[at] + length - 1])
                    rows.append(row)
                    size += len(out[-1])
                at = done + len(out)
                if size > 4 << 20:
                    yield _fetched(batch.column(0), rows, [f.slice(done, len(out)) for f in fields[:6]], out)
                    done, rows, out, size = at, [], [], 0
            if out:
                yield _fetched(batch.column(0), rows, [f.slice(done, len(out)) for f in fields[:6]], out)

    return run


def _fetched(keys: pa.Array, rows: list[int], fields: list[pa.Array], out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*fields, keys.take(pa.array(rows)), pa.array(out, pa.binary())], ["kind", "grp", "more", "part", "once", "first", "key", "bytes"])


RUNS, WINDOWS = 0, 1
SPAN, AGAIN, ODD, LEFT = 0, 1, 2, 3
_SETTLED = "what int, grp long, once boolean, key binary, lo long, hi long"


def _settle(length: int, bits: int):
    """Items sorted by kind, group and part in; what the sort of their suffixes tells out.

    Groups are sorted several at a time: what is equal to another's is repeated
    whatever groups they are of.
    """
    mask = np.uint64((1 << bits) - 1)

    def told(what: int, grp, once, key: pa.Array, lo, hi) -> pa.RecordBatch:
        cols = [pa.array(np.full(len(key), what, np.int32)), pa.array(grp, pa.int64()), pa.array(once, pa.bool_()), key, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["what", "grp", "once", "key", "lo", "hi"])

    def whole_runs(grp, more, part, once, first, key, pieces) -> Iterator[pa.RecordBatch]:
        cls = equal_pieces(pieces)
        last = first + np.array([len(p) for p in pieces]) - length
        several = once & (np.bincount(cls)[cls] > 1)
        at = np.flatnonzero(several)
        yield told(SPAN, grp[at], once[at], key.take(pa.array(at)), first[at], last[at])
        # One of each content of a group and part.
        edge = np.concatenate([[True], (grp[1:] != grp[:-1]) | (part[1:] != part[:-1])])
        own = np.cumsum(edge) - 1
        _, rep = np.unique(own * (int(cls.max()) + 1) + cls, return_index=True)
        contents = np.bincount(own[rep])
        for what, at in ((AGAIN, rep[more[rep]]), (ODD, rep[~more[rep] & (contents[own[rep]] > 1)])):
            yield told(what, grp[at], (once & ~several)[at], key.take(pa.array(at)), first[at], last[at])

    def windows(grp, more, part, once, first, key, pieces) -> Iterator[pa.RecordBatch]:
        piece, place, twice, fresh = window_classes(pieces, length)
        at = np.flatnonzero(twice & once[piece])
        who, lo, hi = stretches(place[at], piece[at])
        yield told(SPAN, grp[who], once[who], key.take(pa.array(who)), first[who] + lo, first[who] + hi)
        at = np.flatnonzero(fresh & more[piece])
        if len(at):
            data, begins = joined(pieces)
            h, start = prefix_hashes(data), begins[piece[at]] + place[at]
            name = mixed((h[start + length] - h[start]) * powers(len(h), inverse=True)[start]) & mask
            lo = first[piece[at]] + place[at]
            yield told(LEFT, name.view(np.int64), (once[piece] & ~twice)[at], key.take(pa.array(piece[at])), lo, lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            kind = table.column("kind").to_numpy()
            for k, sort in ((RUNS, whole_runs), (WINDOWS, windows)):
                some = table.filter(pa.array(kind == k)).combine_chunks()
                if some.num_rows:
                    grp, more, part, once, first = (some.column(n).to_numpy() for n in ("grp", "more", "part", "once", "first"))
                    key = some.column("key").combine_chunks()
                    yield from (b for b in sort(grp, more.astype(bool), part, once.astype(bool), first, key, some.column("bytes").to_pylist()) if b.num_rows)

        for batch in batches:
            # Small slices, so that what is held stays small; a group and part stays whole.
            for k in range(0, batch.num_rows, 1024):
                held.append(batch.slice(k, 1024))
                size += held[-1].column("bytes").nbytes
                if size >= SORTED_BYTES:
                    table = pa.Table.from_batches(held)
                    names = [table.column(n).to_numpy() for n in ("kind", "grp", "part")]
                    change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names]))
                    if len(change):
                        cut = int(change[-1]) + 1
                        yield from settled(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        size = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def _hash_windows(length: int, bits: int):
    """(key, text, items) rows in; the windows of the items, named by a hash, out."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(2).to_pylist()
            for row, raw in enumerate(raw_texts(batch.column(1))):
                for item in items[row]:
                    piece = np.frombuffer(raw[item["first"] : item["first"] + item["n"] + length - 1], np.uint8)
                    h = prefix_hashes(piece)
                    name = mixed((h[length:] - h[:-length]) * powers(len(h), inverse=True)[: item["n"]]) & mask
                    n = len(name)
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.ones(n, bool)), batch.column(0).take(pa.array([row] * n)), pa.array(np.arange(item["first"], item["first"] + n))], ["grp", "once", "key", "lo"])

    return run


def _items(rows: DataFrame, kind: int, grp, more, part, once, first, n) -> DataFrame:
    fields = zip((kind, grp, more, part, once, first, n), (f.split() for f in _ITEM.split(", ")))
    return rows.select("key", F.struct(*[(F.lit(v) if isinstance(v, (int, bool)) else F.expr(v)).cast(t).alias(name) for v, (name, t) in fields]).alias("item"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, part: int = PART, bits: int = 64) -> DataFrame:
    """Of (key, text) rows: key, lo, hi, the first and last start of stretches of repeated windows.

    ``key`` is a binary name of the row. ``bits`` of the hashes of runs are used,
    fewer in tests, where runs that differ must then be told apart.
    """
    if not 16 <= length <= 2000:
        raise ValueError("length must be from 16 to 2000 bytes")
    half = (length - length // 4) // 2

    def looked_up(items: DataFrame) -> DataFrame:
        # As many items as the row has runs, at most. They are written, so that the shuffles that chose them are gone before texts travel.
        of = written(items.groupBy("key").agg(F.collect_set("item").alias("items")), "items")
        freed(rows.sparkSession)
        return rows.join(of, "key").select("key", "text", "items")

    def settled(items: DataFrame) -> DataFrame:
        pieces = looked_up(items).mapInArrow(_fetch(length), "kind int, grp long, more boolean, part int, once boolean, first long, key binary, bytes binary")
        dealt = pieces.repartition("kind", "grp", "part").sortWithinPartitions("kind", "grp", "part")
        told = written(dealt.mapInArrow(_settle(length, bits), _SETTLED), "settled")
        freed(rows.sparkSession)
        return told

    def confirmed(items: DataFrame) -> list[DataFrame]:
        """Sort items and, of groups in several parts, one of each content again, until each group was in one part.

        Parts grow from round to round, so that even a group in which contents differ comes to an end.
        """
        out, size = [], part
        while True:
            out.append(settled(items))
            again = out[-1].where(F.col("what") == AGAIN)
            groups = again.groupBy("grp").agg(F.count("*").alias("_m"))
            left = written(spread_join(again, groups, ["grp"], "key", how="inner"), "again")
            if not left.limit(1).count():
                return out
            size *= 4
            items = _items(left, RUNS, "grp", f"_m > {size}", f"pmod(xxhash64(key, lo, {len(out)}), 1 + _m div {size})", "once", "lo", "hi - lo + 1")

    def windows_confirmed(windows: DataFrame) -> list[DataFrame]:
        """Windows (grp, once, key, lo), named by hashes: those that occur twice are sorted as runs of one window."""
        groups = windows.groupBy("grp").agg(F.count("*").alias("_m"), F.max("once").alias("_o")).where("_m > 1 AND _o").drop("_o")
        return confirmed(_items(spread_join(windows, groups, ["grp"], "lo", how="inner"), RUNS, "grp", f"_m > {part}", f"pmod(xxhash64(key, lo), 1 + _m div {part})", "once", "lo", 1))

    runs = rows.mapInArrow(_runs(length, bits), "anchor long, whole long, key binary, pos long, left long, right long")
    kinds = runs.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos", "left", "right")).alias("at"))
    shared = kinds.groupBy("anchor").agg(F.sum("n").alias("_runs"), F.count("*").alias("_kinds"), F.sum((F.col("n") == 1).cast("int")).alias("_once")).where("_runs > 1")
    live = written(kinds.join(shared, "anchor"), "kinds")
    freed(rows.sparkSession)

    # Runs that are equal as a whole, by hash.
    twice = live.where("n > 1").select("anchor", "whole", "n")
    again = spread_join(runs.select("anchor", "whole", "key", "pos"), twice, ["anchor", "whole"], "pos", how="inner")
    first, last, place = "shiftright(pos, 24)", "(shiftright(pos, 24) + (shiftright(pos, 12) & 4095))", "(shiftright(pos, 24) + (pos & 4095))"
    whole = _items(again, RUNS, "xxhash64(anchor, whole)", f"n > {part}", f"pmod(xxhash64(key, pos), 1 + n div {part})", True, first, f"{last} - {first} + 1")

    # Different runs with one anchor, of which one occurs once: the windows on either side.
    mixed_ = live.where("_kinds > 1 AND _once > 0").select("anchor", (F.col("n") == 1).alias("once"), "at.*")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("h")), F.struct(F.lit(1).alias("side"), F.col("right").alias("h"))))
    open_ = mixed_.select("anchor", "once", "key", "pos", sides.alias("s")).select("once", "key", "pos", "s.side", "s.h", F.xxhash64("anchor", "s.side", "s.h").alias("grp")).where("h != 0").drop("h")
    groups = open_.groupBy("grp").agg(F.count("*").alias("_m"), F.max("once").alias("_o")).where("_m > 1 AND _o").drop("_o")
    members = spread_join(open_, groups, ["grp"], "pos", how="inner")
    lo, hi = f"if(side = 0, {first}, greatest({first}, {place} - {half - 1}))", f"if(side = 0, least({last}, {place} - {half}), {last})"
    partial = _items(members, WINDOWS, "grp", f"_m > {part}", f"pmod(xxhash64(key, pos), 1 + _m div {part})", "once", lo, f"{hi} - {lo} + 1").where("item.n > 0")

    done = confirmed(whole.unionAll(partial))
    odd = functools.reduce(DataFrame.unionAll, [d.where(F.col("what") == ODD).select("key", F.col("lo").alias("_lo")) for d in done])
    left = done[0].where(F.col("what") == LEFT).select("grp", "once", "key", "lo")
    if left.limit(1).count():
        done += windows_confirmed(left)
    # Different runs with one hash: all windows of all runs with their anchors.
    if odd.limit(1).count():
        placed = runs.select("anchor", "key", "pos", F.expr(first).alias("_lo"))
        anchors = placed.join(odd.distinct(), ["key", "_lo"]).select("anchor").distinct()
        items = _items(placed.join(anchors, "anchor"), WINDOWS, 0, False, 0, True, first, f"{last} - {first} + 1")
        done += windows_confirmed(written(looked_up(items).mapInArrow(_hash_windows(length, bits), "grp long, once boolean, key binary, lo long"), "windows"))
    return functools.reduce(DataFrame.unionAll, [d.where(F.col("what") == SPAN).select("key", "lo", "hi") for d in done])


def covered(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of starts as maximal [from, to) runs of covered bytes."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    cut = np.flatnonzero(lo[1:] > end[:-1])
    return list(zip(lo[np.concatenate([[0], cut + 1])].tolist(), end[np.concatenate([cut, [len(lo) - 1]])].tolist()))


def _spans_of(column: pa.Array, length: int) -> Iterator[list[tuple[int, int]]]:
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, at = column.flatten(), 0
    lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    for n in counts.tolist():
        yield covered(lo[at : at + n], hi[at : at + n], length)
        at += n


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` without key, with the array ``spans`` last.

    Rows equal in id and text have one key, and each brought the same spans: they
    are gathered once a key.
    """
    per = spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return rows.join(per, "key", "left").drop("key")


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, part: int = PART, bits: int = 64) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(row_name(F.col(key), F.col(text)).alias("key"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("doc_id"))
    spans = repeated_spans(rows.select("key", "text"), length, part, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, n, kept = [], [], [], []
            for raw, runs in zip(raw_texts(batch.column(0)), _spans_of(batch.column(2), length)):
                size.append(len(raw))
                gone.append(sum(b - a for a, b in runs))
                n.append(len(runs))
                kept.append(hashlib.sha256(without(raw, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.int64()) for c in (size, gone, n)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(rows, spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with the repeated stretches cut out of their texts.

    Stretches of fewer than ``words`` words stay. A cut may fall inside a
    character; what is left of it goes too.
    """
    others = [n for n in docs.columns if n != text]
    # Own names, so that none of the columns can clash.
    rows = docs.select(row_name(F.col(key), F.col(text)).alias("key"), F.col(text).cast("string").alias("text"), F.struct(*others).alias("others") if others else F.lit(0).alias("others"))
    spans = repeated_spans(rows.select("key", "text"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            new: dict[int, str] = {}
            for row, runs in enumerate(_spans_of(batch.column(2), length)):
                if runs:
                    raw = texts[row].as_py().encode()
                    runs = [(a, b) for a, b in runs if len(raw[a:b].split()) >= words]
                    if runs:
                        new[row] = without(raw, runs).decode("utf-8", "ignore")
            if new:
                changed = np.zeros(len(texts), bool)
                changed[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(list(new.values()), texts.type))
            yield pa.RecordBatch.from_arrays([texts, batch.column(1)], ["text", "others"])

    from pyspark.sql import types as T

    schema = T.StructType().add("text", "string").add(rows.schema["others"])
    cut = with_spans(rows, spans).mapInArrow(run, schema)
    return cut.select(*[F.col("text").alias(n) if n == text else F.col("others")[n].alias(n) for n in docs.columns])
