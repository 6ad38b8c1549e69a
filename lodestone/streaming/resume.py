"""A capture of objects that goes on where it stopped: first the inventory, then packs.

The state folder holds

- ``stream``: the checkpoint of the stream that reads the inventory;
- ``inventory/batch=<n>``: the entries of each batch, written by ``foreachBatch``. A
  batch that is given again is written over with the same rows, and one that is noted
  in ``batches`` is not written at all;
- ``plan``: which object goes into which pack, made once, when the inventory is whole;
- ``done/round=<n>``: the descriptors of packs that are written and renamed. A round is
  a stretch of the packs in their order, of at least ``PACKS_A_ROUND`` and as large as lets
  a run end in ``ROUNDS``: a stop costs one round, and rounds do not grow in number.

A run that stops anywhere is followed by one that first holds the state against what
it must be (``problems``), then takes up what is left. Packs that were not noted as
done are written again; their files get the same names and the same bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import numbered
from ..operators.packing import PACK_BYTES, PACK_OBJECTS, pack
from ..operators.scratch import written
from ..sources import artifacts, files
from .capture import _same_definition

ENTRY = "resource string, key string, etag string, size long"
PACKS_A_ROUND = 256
ROUNDS = 8


def entries(objects: DataFrame, resource: str, key: str, body: str) -> DataFrame:
    """Inventory entries of objects: resource, key, etag, size."""
    return objects.select(F.col(resource).cast("string").alias("resource"), F.col(key).cast("string").alias("key"), F.md5(F.col(body).cast("binary")).alias("etag"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("size"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


_INVENTORY = f"{ENTRY}, batch long"
_BATCH = "batch long, records long"
_PLAN = f"{ENTRY}, pack long"
_DONE = "resource string, pack long, records long, source_bytes long, path string, size long, sha256 string, index_path string, index_size long, index_sha256 string"


def inventory(spark: SparkSession, state: str) -> DataFrame:
    """The entries of the batches that are noted."""
    return _read(spark, f"{state}/inventory", _INVENTORY).join(batches(spark, state).select("batch"), "batch", "left_semi")


def batches(spark: SparkSession, state: str) -> DataFrame:
    return _read(spark, f"{state}/batches", _BATCH)


def plan(spark: SparkSession, state: str) -> DataFrame:
    return _read(spark, f"{state}/plan", _PLAN)


def done(spark: SparkSession, state: str) -> DataFrame:
    return _read(spark, f"{state}/done", _DONE + ", round long").drop("round")


def take_inventory(spark: SparkSession, source: str, schema: T.StructType, state: str, wanted: str, resource: str, key: str, body: str, files_at_once: int | None = None, most_batches: int | None = None) -> int:
    """Enter all objects that are new below ``source``; returns the number of batches noted in this run.

    ``most_batches`` stops after so many, as an interrupted run does.
    """
    _same_definition(spark, state, wanted)
    noted = 0

    def enter(rows: DataFrame, batch: int) -> None:
        nonlocal noted
        if most_batches is not None and noted >= most_batches:
            raise InterruptedError("stopped")
        marker = f"{state}/batches/batch={batch}"
        if files.exists(f"{marker}/_SUCCESS"):
            return
        path = f"{state}/inventory/batch={batch}"
        entries(rows, resource, key, body).write.mode("overwrite").parquet(path)
        count = spark.read.schema(ENTRY).parquet(path).count()
        spark.createDataFrame([(count,)], "records long").coalesce(1).write.mode("overwrite").parquet(marker)
        noted += 1

    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    query = reader.parquet(source).writeStream.foreachBatch(enter).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if most_batches is None or noted < most_batches:
            raise
    return noted


def problems(inventory: DataFrame, batches: DataFrame, plan: DataFrame, done: DataFrame, max_bytes: int = PACK_BYTES, max_objects: int = PACK_OBJECTS) -> DataFrame:
    """(problem, n): what the state must not be, each with the number of cases; no rows if it is sound.

    ``batch_gap``, ``batch_records``: noted batches that do not follow each other, or with
    another number of entries; ``repeated_key``, ``negative_size``: in the inventory;
    ``plan_differs``: planned objects that are not those entered, once packs are planned;
    ``pack_gap``, ``pack_over``, ``pack_order``: packs without a number before, over their
    bounds, or with a key that belongs before; ``done_twice``, ``done_unknown``,
    ``done_differs``: descriptors.
    """
    one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    held = inventory.groupBy("batch").agg(F.count("*").alias("held"))
    ordered = batches.withColumn("rn", F.row_number().over(Window.orderBy("batch")))  # a row a batch
    twice = inventory.groupBy("resource", "key").agg(F.count("*").alias("n")).where("n > 1")
    columns = ["resource", "key", "etag", "size"]
    planned = plan.select(*columns, F.lit(1).alias("side")).unionAll(inventory.select(*columns, F.lit(-1).alias("side")))
    differ = planned.groupBy(*columns).agg(F.sum("side").alias("d"), F.max("side").alias("any")).where("d <> 0")
    has_plan = plan.limit(1).agg((F.count("*") > 0).alias("planned"))
    differ = differ.withColumn("_one", F.lit(1)).join(F.broadcast(has_plan.withColumn("_one", F.lit(1))), "_one").where("planned")
    packs = plan.groupBy("resource", "pack").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    # A row a pack: at most so many as a resource's objects by the bounds of a pack.
    after = packs.withColumn("before", F.lag("hi").over(Window.partitionBy("resource").orderBy("pack"))).withColumn("prior", F.lag("pack").over(Window.partitionBy("resource").orderBy("pack")))
    against = done.join(packs, (done["resource"].eqNullSafe(packs["resource"])) & (done["pack"] == packs["pack"]), "left").select(done["resource"], done["pack"], done["records"], done["source_bytes"], packs["records"].alias("r"), packs["bytes"].alias("b"))
    found = [
        one("batch_gap", ordered.where("batch <> rn - 1")),
        one("batch_records", batches.join(held, "batch", "left").where("records <> coalesce(held, 0)")),
        one("repeated_key", twice),
        one("negative_size", inventory.where("size < 0 OR size IS NULL")),
        one("plan_differs", differ),
        one("pack_gap", after.where("pack <> coalesce(prior, 0) + 1")),
        one("pack_over", packs.where(f"records > {max_objects} OR records > 1 AND bytes > {max_bytes}")),
        one("pack_order", after.where("before >= lo")),
        one("done_twice", done.groupBy("resource", "pack").agg(F.count("*").alias("n")).where("n > 1")),
        one("done_unknown", against.where("r IS NULL")),
        one("done_differs", against.where("r <> records OR b <> source_bytes")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.where("n > 0")


def require_sound(spark: SparkSession, state: str, max_bytes: int, max_objects: int) -> None:
    """Fail with the problems of the state."""
    bad = problems(inventory(spark, state), batches(spark, state), plan(spark, state), done(spark, state), max_bytes, max_objects).collect()
    if bad:
        raise ValueError("the resume state is not sound: " + ", ".join(sorted(f"{r['problem']} ({r['n']})" for r in bad)))


def write_rest(spark: SparkSession, objects: DataFrame, root: str, state: str, wanted: str, resource: str, key: str, body: str, described: list[str] | None = None, max_bytes: int = PACK_BYTES, max_objects: int = PACK_OBJECTS, packs_a_round: int = PACKS_A_ROUND, most_rounds: int | None = None) -> DataFrame:
    """Write the packs that are not done, in rounds; returns the descriptors of all.

    Bodies are those of ``objects`` whose etag is still the one entered; an object that is
    gone or changed fails the run before its round is noted. A round takes at least
    ``packs_a_round`` packs, and more where a run would else have more than ``ROUNDS``.
    ``most_rounds`` stops after so many.
    """
    _same_definition(spark, state, wanted)
    require_sound(spark, state, max_bytes, max_objects)
    entered = inventory(spark, state).drop("batch")
    if not plan(spark, state).limit(1).count():
        planned = pack(entered, "resource", ["key"], "size", max_bytes, max_objects, carried=["etag"])
        planned.select("resource", "key", "etag", "size", "pack").write.mode("overwrite").parquet(f"{state}/plan")
        require_sound(spark, state, max_bytes, max_objects)
    same_pack = F.col("resource").eqNullSafe(F.col("_r")) & (F.col("pack") == F.col("_p"))
    packs = plan(spark, state).groupBy("resource", "pack").agg(F.count("*").alias("records"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    left = packs.join(done(spark, state).select(F.col("resource").alias("_r"), F.col("pack").alias("_p")), same_pack, "left_anti")
    left = written(numbered(left, ["resource", "pack"]), "packs-left")
    each = max(packs_a_round, -(-left.count() // ROUNDS))
    # A row a round: its packs are a stretch of the order of resources and keys.
    ends = lambda f, side: f(F.struct("resource", F.col(side).alias("key"))).alias(side)
    rounds = left.groupBy(F.floor((F.col("rn") - 1) / each).alias("at")).agg(F.sum("records").alias("records"), ends(F.min, "lo"), ends(F.max, "hi")).orderBy("at").collect()
    described = described or []
    now = objects.select(F.col(resource).cast("string").alias("_resource"), F.col(key).cast("string").alias("_key"), F.md5(F.col(body).cast("binary")).alias("_etag"), F.col(body).alias("_body"), F.struct(*described).alias("_told") if described else F.lit(None).alias("_told"))
    place = F.struct(F.col("_resource").alias("resource"), F.col("_key").alias("key"))
    for r in rounds[:most_rounds]:
        lo, hi = (F.struct(*[F.lit(r[side][c]).cast("string").alias(c) for c in ("resource", "key")]) for side in ("lo", "hi"))
        these = left.where(F.floor((F.col("rn") - 1) / each) == r["at"]).select(F.col("resource").alias("_r"), F.col("pack").alias("_p"))
        part = plan(spark, state).join(these, same_pack, "left_semi")
        found = part.join(now.where((place >= lo) & (place <= hi)), F.col("resource").eqNullSafe(F.col("_resource")) & (F.col("key") == F.col("_key")) & F.col("etag").eqNullSafe(F.col("_etag")))
        named = found.select("resource", F.col("pack").alias("_number"), "_key", "_body", *[F.col("_told")[c].alias(c) for c in described])
        told = artifacts.write_packed(named, root, "resource", "_number", "_key", "_body", described)
        if told.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"] != r["records"]:
            raise ValueError("objects changed since they were entered; start a new state")
        number = 1 + _rounds(spark, state)
        told.select(*[f.split()[0] for f in _DONE.split(", ")]).write.mode("overwrite").parquet(f"{state}/done/round={number}")
    return done(spark, state)


def _rounds(spark: SparkSession, state: str) -> int:
    """The number of the last round that is noted."""
    noted = _read(spark, f"{state}/done", _DONE + ", round long").agg(F.max("round").alias("m")).first()["m"]
    return 0 if noted is None else noted
