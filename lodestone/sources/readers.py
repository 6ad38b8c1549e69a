"""Sources: inventories, items, records, messages, bundles, profile names."""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bounds import with_prefix
from . import files


def inventory(objects: DataFrame, key: Column, body: Column, etag: Column | None = None) -> DataFrame:
    """(key, etag, size, metadata_digest) of a table of bodies."""
    digest = etag if etag is not None else F.md5(body.cast("binary"))
    return objects.select(key.alias("key"), digest.alias("etag"), F.octet_length(body).cast("bigint").alias("size"), F.sha2(F.to_json(F.struct(*[c for c in objects.columns if c != "text"])), 256).alias("metadata_digest"))


def file_inventory(spark: SparkSession, folder: str, prefixes: list[str] | None = None) -> DataFrame:
    """Files below a folder, without reading their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("key"), F.col("length").alias("size"), "modificationTime")
    return with_prefix(files, "key", prefixes) if prefixes else files


def conditional_bodies(inventory_rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies whose etag is still the one listed; the others are not read on."""
    return inventory_rows.join(bodies, ["key", "etag"])


def shard_records(events: DataFrame, shard: Column, sequence: str, max_records: int, max_bytes: int, data: Column) -> DataFrame:
    """Records in (shard, sequence) order within a count and a sum of bytes."""
    rows = events.withColumn("shard", shard).withColumn("data", data)
    leading = rows.orderBy("shard", sequence).limit(max_records)
    total = F.sum(F.octet_length("data")).over(Window.orderBy("shard", sequence).rowsBetween(Window.unboundedPreceding, 0))
    return leading.withColumn("running", total).where(F.col("running") <= max_bytes)


def messages(rows: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The first messages, as one bounded receive gives."""
    return rows.orderBy(*order).limit(most)


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """Parents with their children as a sorted list: rules and targets, functions and aliases."""
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(listed, key, "left")


def without_values(rows: DataFrame, secret: list[str]) -> DataFrame:
    """Metadata of parameters or secrets: the value is never read, and that is told."""
    return rows.drop(*secret).withColumn("value_captured", F.lit(False))


def log_group(groups: DataFrame, column: str, name: str) -> DataFrame:
    """The group of exactly this name; fails if there is none."""
    found = groups.where(F.col(column).startswith(name)).where(F.col(column) == name)
    if not found.limit(1).count():
        raise LookupError(f"no log group {name}")
    return found


def structure_only(include_data: bool) -> None:
    if include_data:
        raise ValueError("this resource has a structure only; no data can be captured")


def discovered(found: dict[str, DataFrame], failures: dict[str, str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of what services found; a service that failed becomes a finding."""
    out = None
    for service in sorted(found):
        rows = found[service].withColumn("service", F.lit(service))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, [("discovery_failed", s) for s in sorted(failures)]


def ndjson(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Items, one JSON a line, compressed or not; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def packed_objects(spark: SparkSession, path: str) -> DataFrame:
    """(name, body, sha256) of the members of tar.gz packs, read as streams; one task a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column(0).to_pylist():
                with files.opened(pack) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
                    for member in tar:
                        if not member.isfile() or member.name.startswith("/") or ".." in member.name.split("/"):
                            raise ValueError(f"unsafe member {member.name}")
                        body = tar.extractfile(member).read()
                        yield pa.RecordBatch.from_pydict({"name": [member.name], "body": pa.array([body], pa.binary()), "sha256": [hashlib.sha256(body).hexdigest()]})

    packs = spark.read.format("binaryFile").load(path).select("path")
    return packs.mapInArrow(run, "name string, body binary, sha256 string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of one of the supported schemas."""
    found = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
    odd = found.where(~F.col("schema_version").isin(1, 2, 3))
    if odd.limit(1).count():
        raise ValueError("unsupported manifest schema")
    return found


def profile_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of the sections of a credentials or config file; nothing else of it is kept."""
    lines = spark.read.text(path)
    name = F.regexp_extract("value", r"^\s*\[\s*(?:profile\s+)?([^\]]+?)\s*\]\s*$", 1)
    return lines.select(name.alias("profile")).where("profile <> ''").distinct()
