"""A corpus pipeline: five stages over ``documents``, each calling one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents.

1. ``language``: documents whose language is not told (no letters, or too narrow
   a margin) go. The dictionaries are learnt from the stage's own input.
2. ``near_duplicates``: of each group of documents that 5-word shingles link at a
   similarity of 0.8 the one with the smallest doc_id stays (of equal ids, the
   one with the smallest digest). Of rows equal in id and text one stays.
   Documents without words link with nothing and all stay.
3. ``repeated_passages``: passages of ``PASSAGE_WORDS`` words or more that also
   stand elsewhere, in this document or another, are cut out wherever they stand,
   the first place included; documents stay, shorter. They are found as strings
   of ``PASSAGE_BYTES`` bytes; overlapping ones make one passage.
4. ``mixing``: rates are fitted so that toxic tokens fall to a fiftieth and
   others stay; a document whose rate rounds to 0 goes, all others stay once.
5. ``tokens``: byte-level BPE ids of what is left, and their round trip.

Defined results: null and empty texts and texts without a letter go in the first
stage, as no language can be told; later stages, given such texts, keep them as
they are (``near_duplicates`` all of them, whatever their ids). Null ids never make
rows one. Very long texts are judged whole in every stage. Ties go by the smaller
id, then by the digest of id and text. Empty tables give empty tables. Other
columns, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, domain_mixing, language_id, ngram_join, suffix_dedup
from lodestone.llm.queries import tokenizer_file
from lodestone.llm.shared import bounded_batches, freed, row_name, scratch_path

#: What each domain's tokens are multiplied by.
CHANGES = {"toxic": 0.02}
#: A repeated passage has this many words at least; it is found by strings of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 250


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # The docs travel as one column, so that none of theirs can clash with what is added.
    kept = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    told = language_id.identify(kept, language_id.learn(docs))
    return told.where(~F.col("rejected")).select("doc.*")


def _named(docs: DataFrame) -> DataFrame:
    """(row, doc): the digest of id and text, and all columns."""
    return docs.select(row_name(F.col("doc_id"), F.col("text")).alias("row"), F.struct(*docs.columns).alias("doc"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    freed(spark)
    classes = ngram_join.similarity_classes(docs).where("n_shingles > 0")
    # Ids may be null or repeat, so the class goes by its root.
    kept = classes.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = _named(docs.where(worded)).join(kept, "row").dropDuplicates(["row"])
    return one.select("doc.*").unionByName(docs.where(~worded))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    freed(spark)
    cut = suffix_dedup.deduplicated(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = domain_mixing.label_toxic(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = domain_mixing.mix(docs, labels, CHANGES, relative=True)
    gone = mixed.where("rate < 0.5").select("row").distinct()
    return _named(docs).join(gone, "row", "left_anti").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("tokens", tokens)]

#: SQL expresses neither compression nor BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
