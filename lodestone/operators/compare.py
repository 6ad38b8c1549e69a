"""Digests, comparison of two snapshots, rollups, set operations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

IDENTITY = ["service", "type", "id"]
# The categories of a change, in the order they are told.
CATEGORIES = ("structure", "dataset", "governance", "operations", "findings", "selection")
#: A bundle lists at most so many files, so its inventory is one bounded group.
MOST_FILES = 100_000


def ordered_digest(key: Column, line: Column) -> Column:
    """Aggregate: sha256 over the lines in key order. For groups of a bounded size."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("v")))), lambda x: x["v"]), ""), 256)


def streamed_digest(lines: DataFrame, group: list[str], order: str, line: str) -> DataFrame:
    """(group..., digest, lines): sha256 over each group's lines in the order; null lines count, but add nothing.

    A digest is sequential: rows are sorted within partitions by Spark, which
    spills, and streamed in constant memory through one pass a group.
    """
    narrow = lines.select(*group, order, line)
    spread = narrow.repartition(*group) if group else narrow.repartition(1)
    k = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, n = None, None, 0
        for batch in batches:
            done = []
            for *who, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or who != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest(), n))
                    current, digest, n = who, hashlib.sha256(), 0
                n += 1
                if text is not None:
                    digest.update(text.encode("utf-8", "surrogatepass"))
            if done:
                yield told(done, batch)
        if digest is not None:
            yield told([(*current, digest.hexdigest(), n)], batch)

    def told(done: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        types = [*(batch.schema.field(i).type for i in range(k)), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], [*group, "digest", "lines"])

    schema = T.StructType([*narrow.schema.fields[:k], T.StructField("digest", T.StringType()), T.StructField("lines", T.LongType())])
    return spread.sortWithinPartitions(*group, order, line).mapInArrow(run, schema)


def pack_freshness(entries: DataFrame, group: list[str]) -> DataFrame:
    """Of (key, etag, size, metadata_digest) entries: kind, digest, records, bytes of each pack.

    Packs may be of any size. Without a metadata digest for every object nothing
    is proven. Entries are worked out once: what is told of them is written.
    """
    nul = F.lit("\x00")
    value = F.sha2(F.concat(F.coalesce("etag", F.lit("")), nul, F.col("size").cast("string"), nul, F.coalesce("metadata_digest", F.lit(""))), 256)
    line = F.concat(F.sha2(F.col("key").cast("binary"), 256), nul, value, F.lit("\n"))
    unproven = F.coalesce(F.col("metadata_digest"), F.lit("")) == ""
    held = written(entries.select(*group, F.col("key").alias("_key"), line.alias("_line"), F.col("size").alias("_size"), unproven.alias("_unproven")), "entries")
    digests = streamed_digest(held, group, "_key", "_line")
    proven = F.count_if("_unproven") == 0
    sums = held.groupBy(*group).agg(F.when(proven, "inventory").otherwise("inventory_unproven").alias("kind"), F.sum("_size").alias("bytes"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in group]
    both = sums.alias("s").join(digests.alias("d"), same)
    return both.select(*[F.col(f"s.{c}").alias(c) for c in group], "kind", "digest", F.col("lines").alias("records"), "bytes")


def _inventory_line() -> Column:
    return F.concat(F.to_json(F.struct(F.col("path").alias("path"), F.col("sha256").alias("sha256"), F.col("size").alias("size"))), F.lit("\n"))


def bundle_identity(files: DataFrame) -> DataFrame:
    """One digest over the (path, sha256, size) inventory of a bundle in path order; fails above ``MOST_FILES``."""
    bounded = files.limit(MOST_FILES + 1).agg(F.count("*").alias("n"), ordered_digest(F.col("path"), _inventory_line()).alias("d"))
    over = F.raise_error(F.lit(f"more than {MOST_FILES} files")).cast("string")
    return bounded.select(F.when(F.col("n") <= MOST_FILES, F.concat(F.lit("sha256:"), F.col("d"))).otherwise(over).alias("identity"), F.col("n").alias("files"))


def inventory_identity(files: DataFrame) -> DataFrame:
    """The digest of ``bundle_identity`` over an inventory of any size."""
    one = streamed_digest(files.select("path", _inventory_line().alias("_line")), [], "path", "_line")
    none = hashlib.sha256().hexdigest()
    return one.agg(F.concat(F.lit("sha256:"), F.coalesce(F.max("digest"), F.lit(none))).alias("identity"), F.coalesce(F.sum("lines"), F.lit(0)).alias("files"))


def optional_digest(text: Column) -> Column:
    """A digest of JSON text; none for null and for an empty list."""
    return F.when(text.isNull() | F.trim(text).isin("null", "[]"), F.lit("")).otherwise(F.sha2(text, 256))


def receipt(baseline: DataFrame, current: DataFrame, source_changed: bool = False, target_changed: bool = False) -> DataFrame:
    """Each resource of either side: added, removed, changed or unchanged, and what changed.

    Both sides have the identity columns, ``<category>_digest`` columns, and
    ``selected``; missing ones count as equal.
    """
    b = baseline.select(*IDENTITY, F.struct(*[c for c in baseline.columns if c not in IDENTITY]).alias("b"))
    c = current.select(*IDENTITY, F.struct(*[c for c in current.columns if c not in IDENTITY]).alias("c"))
    both = b.join(c, IDENTITY, "full_outer")
    has = set(baseline.columns) & set(current.columns)
    told = []
    for name in CATEGORIES:
        column = "selected" if name == "selection" else f"{name}_digest"
        if column in has:
            told.append(F.when(~F.col(f"b.{column}").eqNullSafe(F.col(f"c.{column}")), F.lit(name)))
    told += [F.lit(n) for n, changed in (("source", source_changed), ("target", target_changed)) if changed]
    changes = F.array_compact(F.array(*told)) if told else F.array().cast("array<string>")
    outcome = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.size(changes) > 0, "changed").otherwise("unchanged")
    out = both.select(*IDENTITY, outcome.alias("outcome"), changes.alias("found"))
    return out.select(*IDENTITY, "outcome", F.when(F.col("outcome") == "changed", F.col("found")).otherwise(F.array().cast("array<string>")).alias("categories"))


def outcome_counts(receipts: DataFrame) -> DataFrame:
    return receipts.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "removed", "changed", "unchanged")])


def rollup(resources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per service: resources, those selected, records and bytes of their snapshots."""
    joined = resources.join(snapshots.select(*IDENTITY, "records", "bytes"), IDENTITY, "left")
    return joined.groupBy("service").agg(
        F.count("*").alias("resources"),
        F.count_if("selected").alias("selected"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def dataset_mismatches(headers: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Datasets whose totals are not the sums over their chunks."""
    sums = chunks.groupBy(key).agg(F.sum("records").alias("_r"), F.sum("bytes").alias("_b"))
    odd = (F.col("records") != F.coalesce("_r", F.lit(0))) | (F.col("bytes") != F.coalesce("_b", F.lit(0)))
    return headers.join(sums, key, "left").where(odd).select(*headers.columns)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target overlaid by the source, column by column; a null of the source overlays nothing."""
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in rest])
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in rest])
    return t.join(s, keys, "full_outer").select(*keys, *[F.coalesce(f"_s_{c}", f"_t_{c}").alias(c) for c in rest])


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in the order; combined on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def merge_maps(target: Column, source: Column) -> Column:
    """Tags of the target overlaid by those of the source."""
    kept = F.map_filter(target, lambda k, v: ~F.map_contains_key(source, k))
    return F.map_concat(kept, source)


def finding_projection(findings: DataFrame) -> DataFrame:
    """Findings without what they say in words."""
    return findings.select("code", "severity", "support", "resource", "property")


def grouped_to(resources: DataFrame, operations: DataFrame, findings: DataFrame) -> DataFrame:
    """Resources with digests of their operations (by service and id) and findings (by id only)."""
    ops = operations.groupBy("service", F.col("resource_id").alias("id")).agg(ordered_digest(F.col("stage"), F.concat_ws("\x00", "stage", "action")).alias("operations_digest"))
    found = findings.groupBy(F.col("resource").alias("id")).agg(ordered_digest(F.concat_ws("\x00", "code", "property"), F.concat_ws("\x00", "code", "severity", "property")).alias("findings_digest"))
    out = resources.join(ops, ["service", "id"], "left").join(found, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("operations_digest", "findings_digest")})
