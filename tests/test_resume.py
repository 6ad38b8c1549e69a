"""Captures that stop and go on: the same packs as an unstopped one; unsound states are refused."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import capture, resume


@pytest.fixture
def objects(spark, tmp_path):
    rows = [("ab"[k % 2], f"k{k:03d}", f"body {k} " * (k % 9)) for k in range(60)]
    frame = spark.createDataFrame(rows, "bucket string, key string, body string")
    frame.repartition(6).write.parquet(f"file://{tmp_path}/landing")
    return frame


def digests(folder):
    return {os.path.relpath(f, folder): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{folder}/**/*.gz", recursive=True)}


def run(spark, tmp_path, objects, name, enters, writes):
    state, root = f"file://{tmp_path}/{name}-state", f"file://{tmp_path}/{name}"
    for most in enters:
        resume.take_inventory(spark, f"file://{tmp_path}/landing", objects.schema, state, "w", "bucket", "key", "body", files_at_once=1, most_batches=most)
    for most in writes:
        told = resume.write_rest(spark, spark.read.parquet(f"file://{tmp_path}/landing"), root, state, "w", "bucket", "key", "body", None, 300, 4, packs_a_round=3, most_rounds=most)
    return state, sorted(map(tuple, told.drop("round").collect())), digests(f"{tmp_path}/{name}")


def test_stopped_runs_end_as_an_unstopped_one(spark, tmp_path, objects):
    whole = run(spark, tmp_path, objects, "whole", [None], [None])
    pieces = run(spark, tmp_path, objects, "pieces", [1, 2, None, None], [1, 2, None, None])
    assert whole[1:] == pieces[1:] and len(whole[1]) > 12
    assert resume.inventory(spark, pieces[0]).count() == 60


def test_a_pack_that_was_not_noted_is_written_again(spark, tmp_path, objects):
    whole = run(spark, tmp_path, objects, "whole", [None], [None])
    state, _, _ = run(spark, tmp_path, objects, "cut", [None], [2])
    # A round whose files were written, but which was not noted.
    import shutil

    shutil.rmtree(f"{tmp_path}/cut-state/done/round=2")
    _, told, files = run(spark, tmp_path, objects, "cut", [None], [None])
    assert (told, files) == whole[1:]


def test_rounds_do_not_grow_with_the_packs(spark, tmp_path, objects):
    gaps = objects.withColumn("bucket", F.when(F.col("bucket") == "b", F.col("bucket")))
    gaps.repartition(6).write.mode("overwrite").parquet(f"file://{tmp_path}/landing")
    state, root = f"file://{tmp_path}/many-state", f"file://{tmp_path}/many"
    resume.take_inventory(spark, f"file://{tmp_path}/landing", objects.schema, state, "w", "bucket", "key", "body")
    write = lambda most: resume.write_rest(spark, gaps, root, state, "w", "bucket", "key", "body", None, 300, 1, packs_a_round=1, most_rounds=most)
    # 60 packs of one object: rounds of 8, then the 44 that are left in rounds of 6.
    assert write(2).count() == 16
    told = write(None)
    assert told.count() == 60 and resume._rounds(spark, state) == 2 + 8
    assert told.groupBy("resource").count().count() == 2 and told.agg(F.sum("records")).first()[0] == 60


def test_a_repeated_batch_writes_nothing(spark, tmp_path, objects):
    state, _, _ = run(spark, tmp_path, objects, "one", [None], [0])
    before = sorted(glob.glob(f"{tmp_path}/one-state/inventory/**/*.parquet", recursive=True))
    # The stream forgets its last batch, as after a crash between the batch and its commit.
    last = max(glob.glob(f"{tmp_path}/one-state/stream/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")) if os.path.exists(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")) else None
    noted = resume.take_inventory(spark, f"file://{tmp_path}/landing", objects.schema, state, "w", "bucket", "key", "body", files_at_once=1)
    assert noted == 0 and sorted(glob.glob(f"{tmp_path}/one-state/inventory/**/*.parquet", recursive=True)) == before
    assert resume.inventory(spark, state).count() == 60


def test_another_definition_is_refused(spark, tmp_path, objects):
    state, _, _ = run(spark, tmp_path, objects, "one", [None], [1])
    with pytest.raises(ValueError, match="definition changed"):
        resume.write_rest(spark, objects, f"file://{tmp_path}/one", state, "other", "bucket", "key", "body")


def test_an_unsound_state_is_refused(spark, tmp_path, objects):
    state, _, _ = run(spark, tmp_path, objects, "one", [None], [1])
    resume.done(spark, state).limit(1).withColumn("records", F.lit(99).cast("long")).write.parquet(f"{state}/done/round=50")
    with pytest.raises(ValueError, match="done_differs .1., done_twice .1."):
        run(spark, tmp_path, objects, "one", [], [None])


def test_changed_bodies_are_refused(spark, tmp_path, objects):
    state, _, _ = run(spark, tmp_path, objects, "one", [None], [1])
    other = objects.withColumn("body", F.concat("body", F.lit("!")))
    with pytest.raises(ValueError, match="changed since"):
        resume.write_rest(spark, other, f"file://{tmp_path}/one", state, "w", "bucket", "key", "body", None, 300, 4, packs_a_round=3)


def test_every_batch_of_a_long_capture_is_told(spark, tmp_path):
    landing = f"file://{tmp_path}/many"
    spark.range(130).repartitionByRange(130, "id").write.parquet(landing)
    told = capture.capture(spark, landing, spark.range(1).schema, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "w", files_at_once=1)
    files = len(glob.glob(f"{tmp_path}/many/*.parquet"))
    assert len(told) == files > 100 and [r["sequence"] for r in told] == list(range(1, files + 1)) and told[-1]["completed"] == 130
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 130
