"""Integrity checks and admission. Each check is a table of violations."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import has_credentials, safe_path
from ..plans.policy import Admission, duration


def coverage(index: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): missing, unexpected, repeated and unsafe paths, and files that differ from the index.

    Both sides meet in one shuffle by path; a path has a row or two of each.
    """
    side = lambda rows, mine, other: rows.select("path", F.struct("sha256", "size").alias(mine), F.lit(None).cast("struct<sha256:string,size:bigint>").alias(other)).select("path", "listed", "found")
    of = lambda rows: rows.select("path", F.col("sha256").cast("string").alias("sha256"), F.col("size").cast("bigint").alias("size"))
    both = side(of(index), "listed", "found").unionAll(side(of(files), "found", "listed"))
    met = both.groupBy("path").agg(F.count("listed").alias("n"), F.count("found").alias("m"), F.collect_set("listed").alias("listed"), F.collect_set("found").alias("found"))
    pair = lambda test: F.exists("listed", lambda a: F.exists("found", lambda b: test(a, b)))
    told = F.array(
        F.when(F.col("m") == 0, "missing_file"),
        F.when(F.col("n") == 0, "unexpected_file"),
        F.when(F.col("n") > 1, "duplicate_path"),
        F.when((F.col("n") > 0) & ~safe_path(F.col("path")), "unsafe_path"),
        F.when(pair(lambda a, b: a["size"] != b["size"]), "size_mismatch"),
        F.when(pair(lambda a, b: (a["size"] == b["size"]) & (a["sha256"] != b["sha256"])), "checksum_mismatch"),
    )
    return met.select("path", F.explode(F.array_compact(told)).alias("problem"))


def unlisted_artifacts(artifacts: DataFrame, index: DataFrame) -> DataFrame:
    """Artifacts of a manifest that the index does not have with the same digest and size."""
    return artifacts.join(index.select("path", "sha256", "size"), ["path", "sha256", "size"], "left_anti")


def provenance_mismatch(provenance: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The provenance row if no manifest row agrees on all keys."""
    return provenance.join(manifest.select(*keys), keys, "left_anti")


def credential_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of rows that hold credentials; a run may go on only if there are none."""
    return rows.where(has_credentials(F.col(text))).select(key)


def require_none(violations: DataFrame, code: str) -> None:
    """Fail on the first violation; its row is not told, only the code."""
    if violations.limit(1).count():
        raise ValueError(code)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size) of all files below a folder, each read in pieces by a task."""
    from ..sources.files import summed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [summed(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int64())], ["path", "sha256", "size"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/") + "/")
    relative = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), root, F.lit("\\E")), 2), 2)
    return files.select(relative.alias("name"), "path").mapInArrow(run, "path string, sha256 string, size long")


def admission_reasons(facts: DataFrame, findings: DataFrame, policy: Admission, now: datetime, key: str = "id") -> DataFrame:
    """Each snapshot: whether it is let in, and the sorted reasons why not.

    ``facts``: key, account, captured_at (timestamp, UTC), repository, workflow.
    ``findings``: key, code, severity.
    """
    account = F.when(~F.coalesce(F.col("account").isin(*policy.allowed_accounts), F.lit(False)), "source_account_not_allowed")
    age = F.lit(None).cast("string")
    if policy.max_age:
        oldest = now - duration(policy.max_age)
        age = F.when(F.col("captured_at").isNull(), "capture_time_missing").when(F.col("captured_at") < F.lit(oldest.replace(tzinfo=None)).cast("timestamp_ntz"), "fixture_expired")
    bound = F.lit(None).cast("string")
    if policy.producer_repository or policy.producer_workflow:
        met = (F.col("repository") == policy.producer_repository) & (F.col("workflow") == policy.producer_workflow)
        bound = F.when(~F.coalesce(met, F.lit(False)), "producer_binding_unverified")
    allowed = F.coalesce(F.col("code").isin(*policy.allowed_finding_codes), F.lit(False)) | F.coalesce(F.col("severity").isin(*policy.allowed_severities), F.lit(False))
    denied = findings.where(~allowed).groupBy(key).agg(F.collect_set(F.concat(F.lit("finding_"), F.col("code"))).alias("_f"))
    own = F.array_compact(F.array(account, age, bound))
    out = facts.join(denied, key, "left").withColumn("reasons", F.array_sort(F.array_distinct(F.concat(own, F.coalesce("_f", F.array().cast("array<string>"))))))
    return out.select(key, (F.size("reasons") == 0).alias("allowed"), "reasons")
