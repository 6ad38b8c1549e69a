"""A ledger of captures: content-addressed blobs, generations, and a pointer to the last one.

Below the ledger's folder lie

- ``blobs/<first two digits>/<sha256>``: each content once, never overwritten;
- ``generations/<name>/units`` and ``/artifacts``: what a capture consisted of;
- ``current/<source>``: the name of the source's last complete generation.

``publish`` admits all blobs first, and verifies those that are there already; then it
writes the generation; then it swaps the pointer. A run that stops anywhere before
leaves the earlier generation in force. Blobs are copied and verified in tasks, a
piece at a time; the driver sees counts and names of problems only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_path
from ..operators.scratch import tasks, written
from . import files

# What can be wrong with an artifact, and why no generation can be read.
MISSING, CORRUPT = "artifact_missing", "artifact_corrupt"
NO_CANDIDATE, FORMAT = "no_candidate", "format_changed"
_HEX = "^[0-9a-f]{64}$"


class LedgerError(ValueError):
    """An artifact that cannot be admitted; ``reason`` is one of the fixed ones."""

    def __init__(self, reason: str, path: str):
        super().__init__(f"{reason}: {path}")
        self.reason, self.path = reason, path


def blob_path(ledger: str, sha256: str) -> str:
    return f"{ledger}/blobs/{sha256[:2]}/{sha256}"


def _problem(path: str, sha256: str, size: int) -> str | None:
    if not files.exists(path):
        return MISSING
    return None if files.summed(path) == (sha256, size) else CORRUPT


def _copied(source: str, target: str, sha256: str, size: int) -> str | None:
    """Copy and verify; what is there already is verified and stays."""
    if files.exists(target):
        return _problem(target, sha256, size)
    if not files.exists(source):
        return MISSING
    draft = f"{target}.{TaskContext.get().taskAttemptId()}"
    with files.opened(source) as f, files.created(draft) as out:
        told = files.passed(f, files.Digested(out))
    if (told.sha256, told.size) != (sha256, size):
        files.removed(draft)
        return CORRUPT
    files.moved(draft, target)
    return None


def _each(rows: DataFrame, judge, name: str = "problem") -> DataFrame:
    """``rows`` with ``judge(path, sha256, size)`` of each as a column, dealt evenly over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("path", "sha256", "size")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    spread = rows.repartition(tasks(rows.sparkSession), "sha256", "path")
    return spread.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def admit(artifacts: DataFrame, root: str, ledger: str) -> DataFrame:
    """Copy artifacts (path, sha256, size, below ``root``) to blobs; one row a content, with its problem or null.

    A content that several artifacts have is copied once, from the first path. Unsafe
    paths and digests that are none count as damaged.
    """
    root, ledger = root.rstrip("/"), ledger.rstrip("/")
    odd = ~safe_path(F.col("path")) | ~F.coalesce(F.col("sha256").rlike(_HEX), F.lit(False)) | ~F.coalesce(F.col("size") >= 0, F.lit(False))
    judged = artifacts.select("path", "sha256", "size", odd.alias("_odd"))
    bad = judged.where("_odd").select("path", "sha256", "size", F.lit(CORRUPT).alias("problem"))
    one = judged.where("NOT _odd").groupBy("sha256", "size").agg(F.min("path").alias("path")).select("path", "sha256", "size")
    done = _each(one, lambda path, sha256, size: _copied(f"{root}/{path}", blob_path(ledger, sha256), sha256, size))
    return written(done.unionAll(bad), "admitted")


def verified(artifacts: DataFrame, ledger: str) -> DataFrame:
    """``artifacts`` with the problem of each one's blob, or null: every use reads it again."""
    ledger = ledger.rstrip("/")
    return _each(artifacts, lambda path, sha256, size: _problem(blob_path(ledger, sha256), sha256, size) if len(sha256 or "") == 64 else CORRUPT)


def materialised(artifacts: DataFrame, ledger: str, root: str) -> DataFrame:
    """Copy blobs to their artifacts' paths below ``root``, verified; ``artifacts`` with the problem of each, or null."""
    root, ledger = root.rstrip("/"), ledger.rstrip("/")

    def one(path: str, sha256: str, size: int) -> str | None:
        try:
            files.safe_path(path)
        except ValueError:
            return CORRUPT
        return _copied(blob_path(ledger, sha256), f"{root}/{path}", sha256, size)

    return written(_each(artifacts, one), "materialised")


def unlisted_blobs(spark: SparkSession, ledger: str, artifacts: DataFrame) -> DataFrame:
    """(sha256): blobs that none of the artifacts has."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{ledger.rstrip('/')}/blobs").select(F.element_at(F.split("path", "/"), -1).alias("sha256"))
    return found.join(artifacts.select("sha256"), "sha256", "left_anti")


def _pointer(ledger: str, source: str) -> str:
    return f"{ledger.rstrip('/')}/current/{hashlib.sha256(source.encode()).hexdigest()}"


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of another in one step."""
    draft = f"{path}.next"
    with files.created(draft) as f:
        f.write(text.encode())
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    at = jvm.org.apache.hadoop.fs.Path
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at(draft), at(path), how)


def publish(units: DataFrame, artifacts: DataFrame, root: str, ledger: str, source: str, generation: str) -> None:
    """Admit the artifacts, write the generation, then let the source's pointer name it.

    ``units``: unit and what tells its freshness; ``artifacts``: unit, kind, path, sha256,
    size. A generation's name is used once. The first artifact that cannot be admitted
    raises ``LedgerError``; the pointer stays as it was.
    """
    spark, folder = units.sparkSession, f"{ledger.rstrip('/')}/generations/{files.safe_path(generation)}"
    bad = admit(artifacts, root, ledger).where("problem IS NOT NULL").orderBy("path").limit(1).collect()
    if bad:
        raise LedgerError(bad[0]["problem"], bad[0]["path"])
    units.withColumn("_source", F.lit(source)).write.parquet(f"{folder}/units")
    artifacts.write.parquet(f"{folder}/artifacts")
    _swap(spark, _pointer(ledger, source), generation)


def load(spark: SparkSession, ledger: str, source: str) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """(units, artifacts, None) of the source's last generation, or (None, None, why there is none)."""
    pointer = _pointer(ledger, source)
    if not files.exists(pointer):
        return None, None, NO_CANDIDATE
    try:
        with files.opened(pointer) as f:
            generation = files.safe_path(f.read(1 << 10).decode())
        folder = f"{ledger.rstrip('/')}/generations/{generation}"
        units, artifacts = (spark.read.parquet(f"{folder}/{n}") for n in ("units", "artifacts"))
        if units.where(~F.col("_source").eqNullSafe(F.lit(source))).limit(1).count():
            return None, None, FORMAT
    except Exception:  # whatever cannot be read is no candidate
        return None, None, FORMAT
    return units.drop("_source"), artifacts, None


def candidates(units: DataFrame, artifacts: DataFrame, ledger: str) -> DataFrame:
    """Units as ``operators.reuse.decide`` takes them: with their artifacts counted and their blobs verified."""
    told = verified(artifacts, ledger).groupBy("unit").agg(F.count_if(F.col("kind") == "data").alias("data_artifacts"), F.count_if(F.col("kind") == "index").alias("index_artifacts"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("kind"))).alias("artifact_problem"))
    return units.join(told, "unit", "left").fillna(0, ["data_artifacts", "index_artifacts"])
