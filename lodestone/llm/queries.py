"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25_search, bpe_codec, domain_mixing, language_id, lexical_rank, merkle_fingerprints, ngram_join, oracles, periodic_runs, secret_scan, stratified_shards, suffix_dedup, token_counts, warc_archive
from .shared import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25_search.top_k(docs, queries, k=10)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=400)


#: Wanted parts of the tokens.
SHARES = {"good": 0.88, "poor": 0.10, "toxic": 0.02}


def op3_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domain_mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = domain_mixing.mix(table(spark, sf_dir, "documents"), labels, SHARES, tries=domain_mixing.TRIES)
    places = F.array_sort(F.array(*[F.lit(d) for d in SHARES]))
    posterior = [F.coalesce(F.element_at("posterior", F.array_position(places, d).cast("int")), F.lit(0.0)).alias(f"p_{d}") for d in SHARES]
    return mixed.select("doc_id", "n_tokens", "domain", *posterior, "rate", "copies", "residual")


def op4_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_archive.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards.interleave(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_rank.postings(table(spark, sf_dir, "documents"))
    return lexical_rank.search(index, table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bm25_top_k, op2_suffix_dedup, op3_domain_mixing, op4_warc_normalise, op5_ngram_jaccard_join, op6_stratified_interleave, op7_language_id, op8_merkle_fingerprints, op9_token_counts, op10_bpe_codec, op11_secret_scan, op12_periodic_runs, op13_lexical_rank)
}
ORACLE_SQL: dict[str, str] = {"op4_warc_normalise": oracles.WARC, "op8_merkle_fingerprints": oracles.MERKLE, "op13_lexical_rank": oracles.LEXICAL}
