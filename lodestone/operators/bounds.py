"""Ordered limits with truncation flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact_prefixes(prefixes: list[str]) -> list[str]:
    """Sorted, without repeats and without those that an earlier one covers."""
    out: list[str] = []
    for p in sorted(set(prefixes)):
        if not out or not p.startswith(out[-1]):
            out.append(p)
    return out


def compacted(rows: DataFrame, column: str) -> DataFrame:
    """The distinct prefixes of a column that no other one covers; null ones are left out.

    A prefix is covered if one of its own beginnings is in the set as well, so each asks
    for its beginnings by equality: a row a character, and no comparison of all pairs.
    """
    prefixes = rows.select(F.col(column).alias("prefix")).where("prefix IS NOT NULL").distinct()
    shorter = F.transform(F.sequence(F.lit(0), F.char_length("prefix") - 1), lambda n: F.left("prefix", n))
    asked = prefixes.where("prefix <> ''").select(F.col("prefix").alias("long"), F.explode(shorter).alias("prefix"))
    covered = asked.join(prefixes, "prefix", "left_semi").select(F.col("long").alias("prefix")).distinct()
    return prefixes.join(covered, "prefix", "left_anti").select(F.col("prefix").alias(column))


def with_prefix(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose column starts with any prefix; pushed down to the scan."""
    found = F.lit(False)
    for p in compact_prefixes(prefixes):
        found = found | F.col(column).startswith(p)
    return rows.where(found)


def object_limit(rows: DataFrame, order: list[str], size: str, max_objects: int, max_object_bytes: int, max_total_bytes: int) -> DataFrame:
    """The leading objects within a count and a total, those that are too large skipped.

    Only the first ``max_objects`` fitting rows can be of the result, so the window
    sees no more than those.
    """
    leading = rows.where(F.col(size) <= max_object_bytes).orderBy(*order).limit(max_objects)
    total = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return leading.withColumn("running", total).where((F.col("running") <= max_total_bytes))


def byte_limit(rows: DataFrame, order: list[str], encoded: Column, max_records: int, max_bytes: int) -> DataFrame:
    """The leading records within a count and a sum of encoded bytes, a line end each."""
    leading = rows.withColumn("encoded_bytes", (F.octet_length(encoded) + 1).cast("bigint")).orderBy(*order).limit(max_records)
    total = F.sum("encoded_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return leading.withColumn("running", total).where(F.col("running") <= max_bytes)


def page_limit(rows: DataFrame, order: list[str], max_items: int) -> tuple[DataFrame, DataFrame]:
    """The leading items, and one row that tells whether more were there."""
    more = rows.limit(max_items + 1).agg((F.count("*") > max_items).alias("truncated"))
    return rows.orderBy(*order).limit(max_items), more


def log_tail(n: int) -> int:
    return n if 0 < n <= 10_000 else 200


def disk_estimate(rows: DataFrame, size: str) -> DataFrame:
    """Bytes to set aside: 1 MiB, and for each object its size, an eighth of it and 64 KiB; 0 for none."""
    each = F.col(size) + F.expr(f"{size} div 8") + (64 << 10)
    total = rows.agg(F.try_sum(each).alias("s"), F.count("*").alias("n"))
    most = (1 << 63) - 1
    sure = F.coalesce(F.try_add(F.col("s"), F.lit(1 << 20).cast("bigint")), F.lit(most))
    return total.select(F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(sure).alias("required_bytes"))
