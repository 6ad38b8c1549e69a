"""Deterministic keyed samples: the same rows whatever their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, count_bucket, hmac_sha256, length_prefix
from ..plans.policy import DEFAULT_RETAINED, DIGEST_BYTES, Cohort, Profile
from .govern import value_at, with_keys


def equals(column: Column, kind: str, expected: object) -> Column:
    """Typed equality: numbers as text, booleans and text as they are; anything else is false."""
    if kind == "boolean":
        found = column == F.lit(expected) if isinstance(expected, bool) else F.lit(False)
    elif isinstance(expected, bool):
        found = F.lit(False)
    elif kind == "string":
        found = column == F.lit(expected) if isinstance(expected, str) else F.lit(False)
    else:
        found = column.cast("string") == F.lit(str(expected)) if not isinstance(expected, str) else F.lit(False)
    return F.coalesce(found, F.lit(False))


def eligible(rows: DataFrame, cohort: Cohort) -> DataFrame:
    """Rows that meet all predicates and have all keys; both may be paths through structs and maps."""
    tests = []
    for path, wanted in cohort.predicates:
        found = value_at(rows, path)
        tests.append(equals(found[0], found[1].simpleString(), wanted) if found else F.lit(False))
    keys = [value_at(rows, k) for k in cohort.key_paths]
    return rows.where(all_of(tests + [k[0].isNotNull() if k else F.lit(False) for k in keys]))


def ranked(rows: DataFrame, profile: Profile, cohort: Cohort, name: str = "rank") -> DataFrame:
    """Eligible rows with their rank: a keyed digest of the length-prefixed key values, paths in order."""
    message = F.concat(*[length_prefix(value_at(rows, k)[0].cast("string")) for k in sorted(cohort.key_paths) if value_at(rows, k)])
    keyed = with_keys(eligible(rows, cohort), {"rank": profile.rank_key(cohort)})
    return keyed.withColumn(name, hmac_sha256(F.col("_i_rank"), F.col("_o_rank"), message)).drop("_i_rank", "_o_rank")


def select(rows: DataFrame, profile: Profile, cohort: Cohort, value: Column) -> DataFrame:
    """The ``limit`` rows of smallest (rank, value); repeated rows count each."""
    return ranked(rows, profile, cohort).withColumn("_value", value).orderBy("rank", "_value").limit(cohort.limit).drop("_value")


def select_per(rows: DataFrame, profile: Profile, cohort: Cohort, group: list[str], ties: list[str]) -> DataFrame:
    """As select(), within each group. A group's best are kept on the map side first."""
    order = Window.partitionBy(*group).orderBy("rank", *ties)
    return ranked(rows, profile, cohort).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cohort.limit)


def retained_bytes(selected: DataFrame, value: Column) -> DataFrame:
    """Bytes that the selection holds: a digest and the value, for each row."""
    return selected.agg(F.coalesce(F.sum(F.octet_length(value) + DIGEST_BYTES), F.lit(0)).cast("bigint").alias("retained_bytes"))


def require_ceiling(selected: DataFrame, cohort: Cohort, value: Column) -> DataFrame:
    """Fail if the final selection is over the cohort's ceiling."""
    most = cohort.max_retained_bytes or DEFAULT_RETAINED
    held = retained_bytes(selected, value).first()["retained_bytes"]
    if held > most:
        raise ValueError(f"the cohort of {cohort.resource} holds {held} bytes; its ceiling is {most}")
    return selected


def audit(rows: DataFrame, cohort: Cohort) -> DataFrame:
    """Eligible and retained counts, as ranges, and whether rows were left out."""
    n = eligible(rows, cohort).agg(F.count("*").alias("n"))
    kept = F.least(F.col("n"), F.lit(cohort.limit))
    return n.select(F.lit(cohort.resource).alias("resource"), count_bucket(F.col("n")).alias("eligible"), count_bucket(kept).alias("retained"), (F.col("n") > cohort.limit).alias("truncated"))
