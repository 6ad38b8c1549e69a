"""Numbers and running sums over ordered rows without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def _placed(rows: DataFrame, by: list[str], slices: int | None) -> DataFrame:
    """Rows in ranges of ``by``, written once, with their range and their place in all (growing, with gaps)."""
    dealt = rows.repartitionByRange(slices, *by) if slices else rows.repartitionByRange(*by)
    return written(dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))


def with_before(rows: DataFrame, order: list[str], within: list[str], value: str, name: str, slices: int | None = None) -> DataFrame:
    """Add the ``value`` of the row before, of those equal in ``within``; null for the first.

    As ``numbered``: neighbours are found inside ranges, and a range's first row of a group
    takes the last value of the group's range before, from a row a group and range.
    """
    keys = [*within, "_range"]
    placed = _placed(rows, [*within, *order], slices)
    ends = placed.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), "_at").alias("_last"), F.min("_at").alias("_first"))
    prior = F.lag("_last").over(Window.partitionBy(*within).orderBy("_range"))
    linked = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_first", prior.alias("_prior"))
    out = placed.withColumn("_lag", F.lag(value).over(Window.partitionBy(*keys).orderBy("_at")))
    out = out.join(linked, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    out = out.withColumn(name, F.when(F.col("_at") == F.col("_first"), F.col("_prior.v")).otherwise(F.col("_lag")))
    return out.drop("_range", "_at", "_lag", "_first", "_prior", *[f"_k{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rn", total: str | None = None, running: str = "running", slices: int | None = None) -> DataFrame:
    """Add the row's number (from 1) in the order, and the running sum of ``total``.

    Rows are dealt into ranges of all order columns (after ``within``), sorted there, and
    written once with their place: Spark's growing ids are the range and the place in
    it. Counts a range move the places up to numbers, so numbers need no window and no
    second shuffle; running sums are made inside ranges and moved up alike. Rows that
    are equal in all order columns share a range.
    """
    within = within or []
    keys = [*within, "_range"]
    placed = _placed(rows, [*within, *order], slices)
    sums = [F.count("*").alias("_n"), F.min("_at").alias("_first")] + ([F.sum(total).alias("_t")] if total else [])
    counts = placed.groupBy(*keys).agg(*sums)
    # A row a range, or a group and range it reaches into.
    before = (Window.partitionBy(*within).orderBy("_range") if within else Window.orderBy("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0")] if total else []))
    if total:
        inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn("_run", F.sum(total).over(inside))
    out = placed.join(starts, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    out = out.withColumn(name, F.col("_n0") + F.col("_at") - F.col("_first") + 1)
    if total:
        out = out.withColumn(running, F.col("_t0") + F.col("_run"))
    return out.drop("_range", "_at", "_run", "_first", "_n0", "_t0", *[f"_k{i}" for i in range(len(keys))])
