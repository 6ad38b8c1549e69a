"""Sharding by proportional stratified interleaving; DataFrame functions only.

Within each source the rows are put in a seeded random order; row ``r`` of
``n`` gets the fractional rank ``(2 r - 1) / 2 n``. Sorted by that, every stretch
of the table holds each source in proportion, so cutting it into equal counts
gives shards that all match the mixture.

No window spans a whole source or the whole table. Ranks are found in two
steps: rows are dealt into ``BUCKETS`` slices of the random order (or of the
fractional rank), numbered inside a slice, and moved up by the number of rows
in the slices before it, which comes from small tables of counts.

Law: ``rows``; shard sizes differ by one row at most. Equal texts are not kept
together, since that law leaves no room for it.

Defined results: a null source is a source of its own; a null text counts 16
bytes and checksum 0; very long texts count by their size and checksum only; rows
that draw alike are ordered by id, checksum and size, equal fractional ranks by source;
repeated rows each get a slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
OVERHEAD = 16


def interleave(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row a document: key, size, text_crc32, lane, position, shard, slot."""
    rows = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_lane"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("_size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("_crc"),
    )
    draw = F.xxhash64(F.lit(seed), F.col("_key"))
    rows = rows.withColumn("_draw", draw).withColumn("_bucket", F.pmod(F.col("_draw"), F.lit(buckets)).cast("int"))

    # Rows of each source before each slice of its random order.
    keyed = docs.select(F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_lane"))
    counts = keyed.withColumn("_bucket", F.pmod(draw, F.lit(buckets)).cast("int")).groupBy("_lane", "_bucket").agg(F.count("*").alias("_n"))
    lane = Window.partitionBy("_lane")
    before = counts.select(
        "_lane",
        "_bucket",
        (F.sum("_n").over(lane.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(lane).alias("_total"),
    )
    in_slice = Window.partitionBy("_lane", "_bucket").orderBy("_draw", "_key", "_crc", "_size")
    ranked = (
        rows.withColumn("_rn", F.row_number().over(in_slice))
        .join(before, ["_lane", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_rn"))
        .withColumn("_slice", _slice("_rank", "_total", buckets))
    )

    # Rows of all sources before each slice of the fractional ranks: for a source of
    # n rows, the number of ranks below slice b follows from n alone.
    lanes = keyed.groupBy("_lane").agg(F.count("*").alias("_n"))
    cuts = lanes.select("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets).cast("long"))).alias("_slice"))
    below = F.when(F.col("_slice") == 0, F.lit(0)).otherwise(F.expr(f"((2 * _n * _slice - 1) div {buckets} + 1) div 2"))
    starts = cuts.groupBy("_slice").agg(F.sum(below).alias("_start"), F.sum("_n").alias("_all"))

    order = Window.partitionBy("_slice").orderBy(F.col("_rank") * 2.0 / F.col("_total") - 1.0 / F.col("_total"), "_lane", "_rank")
    placed = ranked.withColumn("_at", F.row_number().over(order)).join(starts, "_slice").withColumn("_pos", F.col("_start") + F.col("_at") - 1)
    placed = placed.withColumn("_shard", F.expr(f"(_pos * {shards}) div _all"))
    return placed.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_pos").alias("position"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - F.expr(f"(_shard * _all + {shards - 1}) div {shards}")).alias("slot"),
        F.when(F.col("_lane") != "", F.substring("_lane", 2, 1 << 30)).alias("source"),
    )


def _slice(rank: str, total: str, buckets: int) -> Column:
    return F.expr(f"((2 * {rank} - 1) * {buckets}) div (2 * {total})")
