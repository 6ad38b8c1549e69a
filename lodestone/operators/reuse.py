"""Reuse of earlier captures, and the ledger that records them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_before

# The closed set of reasons.
REASONS = ("reused", "no_candidate", "capture_definition_changed", "source_content_changed", "source_unit_missing", "artifact_missing", "artifact_corrupt", "format_changed", "freshness_unproven")
PROVEN = "inventory"


def decide(current: DataFrame, candidate: DataFrame, same_definition: bool = True, load_invalidation: str | None = None) -> DataFrame:
    """Each current pack: reused or refreshed, and why.

    ``current``: unit, kind, digest, records, bytes. ``candidate``: the same and
    outcome, reason, data_artifacts, index_artifacts, artifact_problem (null if
    its blobs verify).
    """
    c = candidate.select("unit", F.struct(*[x for x in candidate.columns if x != "unit"]).alias("c"))
    both = current.join(c, "unit", "left")
    found = F.col("c").isNotNull() & F.lit(same_definition)
    invalid = F.coalesce(F.col("c.outcome") == "invalidated", F.lit(False))
    same = (F.col("kind") == PROVEN) & (F.col("c.kind") == F.col("kind")) & (F.col("c.digest") == F.col("digest")) & (F.col("c.records") == F.col("records")) & (F.col("c.bytes") == F.col("bytes"))
    fresh = found & ~invalid & F.coalesce(same & (F.col("c.data_artifacts") == 1) & (F.col("c.index_artifacts") == 1), F.lit(False))
    reason = (
        F.when(F.lit(not same_definition), "capture_definition_changed")
        .when(F.lit(load_invalidation is not None), F.lit(load_invalidation))
        .when(found & invalid, F.col("c.reason"))
        .when(found, "source_content_changed")
        .otherwise("no_candidate")
    )
    broken = F.col("c.artifact_problem")
    known = F.when(broken.isin(*REASONS), broken).otherwise("artifact_corrupt")
    return both.select(
        *current.columns,
        F.when(fresh & broken.isNull(), "reused").otherwise("refreshed").alias("outcome"),
        F.when(fresh & broken.isNull(), "reused").when(fresh, known).otherwise(reason).alias("reason"),
    )


def table_reason(format_changed: bool, same_definition: bool, has_candidate: bool, invalidation: str | None, unit_reason: str | None) -> str:
    """Why a table, which is never reused, is refreshed."""
    if format_changed:
        return "format_changed"
    if has_candidate and not same_definition:
        return "capture_definition_changed"
    if not has_candidate:
        return invalidation or "no_candidate"
    return unit_reason or invalidation or "freshness_unproven"


def missing_units(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row if fewer records are there than before: how many went, since when."""
    before = previous.where(F.col("unit").startswith("pack-")).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("p"), F.min("captured_at").alias("captured_at"))
    now = current.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"))
    digest = F.sha2(F.concat(F.col("p").cast("string"), F.lit("\x00"), F.col("n").cast("string")), 256)
    # Two tables of one row each, put side by side by a key.
    one = before.withColumn("_k", F.lit(1)).join(now.withColumn("_k", F.lit(1)), "_k").where("n < p")
    return one.select(F.lit("objects-missing").alias("unit"), digest.alias("digest"), (F.col("p") - F.col("n")).alias("records"), F.lit("invalidated").alias("outcome"), F.lit("source_unit_missing").alias("reason"), "captured_at")


def reason_summary(decisions: DataFrame, resource: str) -> DataFrame:
    """Per resource: packs by outcome, and the distinct reasons."""
    return decisions.groupBy(resource).agg(
        F.count_if(F.col("outcome") == "reused").alias("reused"),
        F.count_if(F.col("outcome") == "refreshed").alias("refreshed"),
        F.count_if(F.col("outcome") == "invalidated").alias("invalidated"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def invalid_units(units: DataFrame) -> DataFrame:
    """Units that break the rule: the outcome is reused if and only if the reason is, and reasons are known."""
    known = F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))
    return units.where(~((F.col("outcome") == "reused").eqNullSafe(F.col("reason") == "reused")) | ~known)


def with_previous(generations: DataFrame, resource: str, order: list[str], generation: str, name: str = "previous") -> DataFrame:
    """Each unit with the generation before its own, of its resource; a resource of most rows is dealt over ranges."""
    return with_before(generations, order, [resource], generation, name)


def publish(units: DataFrame, path: str, generation: str) -> None:
    """Add a generation to the ledger; a generation is written once."""
    units.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(path)


def candidates(spark, path: str, generation: str) -> DataFrame:
    """The units of one generation: only its partition is read."""
    return spark.read.parquet(path).where(F.col("generation") == generation).drop("generation")
