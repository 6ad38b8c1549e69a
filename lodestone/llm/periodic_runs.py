"""Periodic runs of words, found by bit-parallel lags.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical), of at least ``max(least, repeats * q)`` words, that no
neighbouring word extends with that period.

The words of a text are numbered by first occurrence. Bit ``i`` of plane ``b`` is bit
``b`` of word ``i``'s number, each plane one big integer. For a lag ``q`` the planes
are shifted by ``q`` and XORed with themselves; a mismatch of any plane is a
mismatch of the words, so their OR has a zero where words ``q`` apart are the same.
A run needs ``length - q`` zeros on end: ANDing the zeros with themselves shifted by
1, 2, 4, ... leaves a bit for each start of so long a stretch. That is done after
each few planes, so a lag without such a stretch is given up early, mostly after
the first planes. A stretch found at ``q`` and at a divisor of ``q`` is one run, of
the smaller period.

Rows are judged one at a time, nothing is shuffled; memory is a few times the
text. The time of a text grows with the square of its words, a machine word of 64
words at a time.

Defined results: a null or empty text, or one of white space, has no words and no
runs; repeated rows give repeated rows; very long texts are judged whole; an empty
table gives no rows; other columns are passed on (one named as an added column is
renamed ``<name>_given``). Runs are listed by start, then period.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
LEAST, REPEATS = 6, 4
#: Planes between two looks for stretches.
PLANES_A_LOOK = 3
_WORDS = re.compile(WORD)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ADDED = {"n_words": T.LongType(), "runs": T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long")), "collapsed": T.StringType()}


def planes_of(words: list[str]) -> list[int]:
    """The bit planes of the words' numbers."""
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    bits = max(len(numbers) - 1, 0).bit_length()
    return [int.from_bytes(np.packbits(((ids >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def long_stretches(bits: int, size: int) -> int:
    """The bits at which ``size`` set bits on end begin."""
    have = 1
    while have < size and bits:
        step = min(have, size - have)
        bits &= bits >> step
        have += step
    return bits


def matching(planes: list[int], n: int, lag: int, size: int) -> int:
    """The starts of stretches of ``size`` places whose words equal those ``lag`` on; see the module."""
    whole = (1 << (n - lag)) - 1
    differ, starts = 0, 0 if planes else long_stretches(whole, size)
    for k in range(0, len(planes), PLANES_A_LOOK):
        for p in planes[k : k + PLANES_A_LOOK]:
            differ |= p ^ (p >> lag)
        starts = long_stretches(whole ^ (differ & whole), size)
        if not starts:
            break
    return starts


def bit_stretches(bits: int) -> Iterator[tuple[int, int]]:
    """(first place, number) of each stretch of set bits."""
    at = 0
    while bits:
        skip = (bits & -bits).bit_length() - 1
        bits >>= skip
        at += skip
        size = (~bits & (bits + 1)).bit_length() - 1
        yield at, size
        bits >>= size
        at += size


def runs_of(words: list[str], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    n, planes = len(words), planes_of(words)
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, n // repeats + 1):
        size = max(least, repeats * lag) - lag
        if size > n - lag:
            continue
        for at, more in bit_stretches(matching(planes, n, lag, size)):
            found.setdefault((at, more + size - 1 + lag), lag)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g] if runs else words


def find(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period) and collapsed (the kept words, joined by a space) added."""
    if repeats < 2 or least < 2:
        raise ValueError("a run repeats its period and has two words at least")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for t in batch.column(place):
                words = _WORDS.findall(t.as_py() or "")
                own = runs_of(words, least, repeats)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                collapsed.append(" ".join(kept_words(words, own)))
            cols = [*batch.columns, pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *_ADDED])

    kept = docs.withColumnsRenamed({n: f"{n}_given" for n in _ADDED if n != text})
    schema = T.StructType(list(kept.schema))
    for name, kind in _ADDED.items():
        schema = schema.add(name, kind)
    return kept.mapInArrow(run, schema)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts made periodic from a word on, as the contract of ``op12_periodic_runs`` asks."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("_h", h).withColumn("_words", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), words))
    rows = rows.withColumn("_n", F.size("_words")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.expr("_g % _n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    made = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, _words[cast(_a + (i - _a) % _p AS int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length, of equal ones the first by start, then period; null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the kept words."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", longest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
