"""Sinks: chunks, packs, bundles, upserts, overwrite rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How objects that are already there are treated.
OVERWRITE = ("never", "if-different", "always")


def write_chunks(rows: DataFrame, path: str, order: list[str], line: str, gzip: bool = True, parts: int | None = None) -> None:
    """Lines in order across part files: sorted ranges, each sorted, one file a range."""
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(line).write.option("compression", "gzip" if gzip else "none").text(path)


def to_put(source: DataFrame, target: DataFrame, overwrite: str, key: str = "key", digest: str = "sha256") -> DataFrame:
    """The objects that must be written under an overwrite rule."""
    if overwrite not in OVERWRITE:
        raise ValueError(f"unknown overwrite rule {overwrite}")
    there = target.select(key, F.col(digest).alias("_there"))
    joined = source.join(there, key, "left")
    if overwrite == "never":
        joined = joined.where("_there IS NULL")
    elif overwrite == "if-different":
        joined = joined.where(F.col("_there").isNull() | (F.col("_there") != F.col(digest)))
    return joined.drop("_there")


def require_shape(found: DataFrame, expected: DataFrame) -> None:
    """A target that is there must have the expected columns; it is never made anew."""
    if dict(found.dtypes) != dict(expected.dtypes):
        raise ValueError("the target has another shape")


def put_batches(rows: DataFrame, send: Callable[[list], list], size: int = 25, attempts: int = 8, pause: float = 0.05) -> None:
    """Send rows in batches from the tasks; what is not taken is sent again, later each time."""

    def run(part) -> None:
        import itertools
        import random
        import time

        part = iter(part)
        while batch := list(itertools.islice(part, size)):
            for k in range(attempts):
                batch = send(batch)
                if not batch:
                    break
                time.sleep(random.uniform(0, min(5.0, pause * 2**k)))
            else:
                raise RuntimeError(f"{len(batch)} rows were not taken after {attempts} attempts")

    rows.foreachPartition(run)


def install(spark: SparkSession, staged: str, target: str, guard: Callable[[], None] = lambda: None) -> None:
    """Swap a staged folder in, keeping the old one until the new is in place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    new, old, backup = path(staged), path(target), path(target.rstrip("/") + ".backup")
    files = new.getFileSystem(conf)
    guard()
    had = files.exists(old)
    if had and not files.rename(old, backup):
        raise OSError("the old bundle could not be moved away")
    if not files.rename(new, old):
        if had:
            files.rename(backup, old)
        raise OSError("the new bundle could not be moved in")
    if had:
        files.delete(backup, True)
