"""Resumable capture by Structured Streaming."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.policy import digest


def definition(resource: str, options: dict, policy_identity: str | None = None) -> str:
    """A digest of all that decides what is captured."""
    return digest({"resource": resource, "options": options, "policy": policy_identity})


def _same_definition(spark: SparkSession, checkpoint: str, wanted: str) -> None:
    """A capture goes on only under the definition it began with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/definition")
    files = path.getFileSystem(conf)
    if files.exists(path):
        before = spark.read.text(path.toString()).first()[0]
        if before != wanted:
            raise ValueError("the capture definition changed; start a new checkpoint")
        return
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(path.toString())


class Progress(StreamingQueryListener):
    """A record of every batch of the queries it listens to, however many there are.

    A query itself remembers its last hundred batches only.
    """

    def __init__(self) -> None:
        self.records: list[dict] = []
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            total = self.records[-1]["completed"] if self.records else 0
            self.records.append({"sequence": len(self.records) + 1, "batch": p.batchId, "records": p.numInputRows, "completed": total + p.numInputRows})

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def ended(self, run: str, seconds: float = 60) -> None:
        """Wait until all that a run has told has arrived."""
        if not self._end(run).wait(seconds):
            raise TimeoutError("the stream's progress did not arrive")


def capture(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, wanted: str, transform=lambda d: d, files_at_once: int | None = None) -> list[dict]:
    """Take in all files that are new since the last run; returns a record of each batch: sequence, batch, records, completed.

    Offsets live in the checkpoint, rows are written once. An interrupted run goes
    on from the last finished batch.
    """
    _same_definition(spark, checkpoint, wanted)
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        query = transform(reader.parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.ended(str(query.runId))
    finally:
        spark.streams.removeListener(progress)
    return progress.records


def progress_lines(logs: DataFrame, column: str, prefix: str, schema: str) -> DataFrame:
    """Progress events among log lines: those with the prefix, decoded."""
    return logs.where(F.col(column).startswith(prefix)).select(F.from_json(F.substr(F.col(column), F.lit(len(prefix) + 1)), schema).alias("e")).select("e.*")


def readiness(status: Column, waited: Column, most: int) -> Column:
    """ready, failed, timeout or waiting, from a state and how long it took."""
    return F.when(status == "ready", "ready").when(status.isin("exited", "failed"), "failed").when(waited >= most, "timeout").otherwise("waiting")
