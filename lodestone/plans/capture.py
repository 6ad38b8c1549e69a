"""Queries that write and read back: chunks, packs, overwrite rules, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing
from ..operators.scratch import folder as _folder
from ..sources import readers, sinks
from ..streaming.capture import capture, definition, progress_lines, readiness
from .registry import query, table


@query("SELECT event_id, event_type, props FROM events")
def src19_ndjson_roundtrip(spark, sf_dir):
    """Items written as gzipped NDJSON chunks in key order and read back."""
    path = _folder(spark, "ndjson")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    sinks.write_chunks(events.withColumn("line", F.to_json(F.struct("event_id", "event_type", "props"))), path, ["event_id"], "line")
    return readers.ndjson(spark, path, "event_id long, event_type string, props string")


@query("SELECT p_partkey, p_name FROM part")
def snk2_sorted_parts(spark, sf_dir):
    """Part files of sorted ranges; every file is sorted, and so are their ranges."""
    path = _folder(spark, "parts")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    sinks.write_chunks(part.withColumn("line", F.to_json(F.struct("p_partkey", "p_name"))), path, ["p_partkey"], "line", parts=4)
    return readers.ndjson(spark, path, "p_partkey long, p_name string")


def _objects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("key"), F.sha2("text", 256).alias("sha256"))
    target = docs.where("doc_id % 4 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 6 == 1, F.lit("old")).otherwise(F.col("sha256")))
    return docs, target


@query(
    """SELECT 'never' AS rule, doc_id FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'if-different', doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 1
    UNION ALL SELECT 'always', doc_id FROM documents"""
)
def snk11_overwrite(spark, sf_dir):
    source, target = _objects(spark, sf_dir)
    out = [sinks.to_put(source, target, rule).select(F.lit(rule).alias("rule"), "doc_id") for rule in sinks.OVERWRITE]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 + 1 AS pack, doc_id FROM documents")
def snk3_packs_by_count(spark, sf_dir):
    """Packs of 50 objects each, written partitioned by pack and read back."""
    path = _folder(spark, "packs")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    packing.pack(docs, "source", ["doc_id"], "size", 1 << 60, 50).write.partitionBy("pack").parquet(path)
    return spark.read.parquet(path).select("source", F.col("pack").cast("bigint").alias("pack"), "doc_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def str1_resume(spark, sf_dir):
    """Events captured in two runs of one stream: the second goes on where the first stopped."""
    landing, target, state = (_folder(spark, n) for n in ("landing", "captured", "capture-state"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    wanted = definition("events", {"drop": "error"})
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(landing)
        capture(spark, landing, events.schema, target, state, wanted, lambda d: d.where("event_type <> 'error'"))
    return spark.read.parquet(target)


@query("SELECT event_id, user_id AS done FROM events WHERE event_type = 'click'")
def str6_progress_lines(spark, sf_dir):
    line = F.concat(F.when(F.col("event_type") == "click", "progress ").otherwise("log "), F.to_json(F.struct("event_id", F.col("user_id").alias("done"))))
    return progress_lines(table(spark, sf_dir, "events").select(line.alias("line")), "line", "progress ", "event_id long, done long")


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'ready' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 100 >= 60 THEN 'timeout' ELSE 'waiting' END AS state FROM events")
def str7_readiness(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type") == "error", "failed").otherwise("starting")
    return table(spark, sf_dir, "events").select("event_id", readiness(status, F.col("event_id") % 100, 60).alias("state"))
