"""Registered queries of the operators for training data, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import frequency, packing, repetition, tokenizing, weighting


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_marks(_table(spark, folder, "token_entries"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_term_counts(spark, folder).where("mark IS NOT NULL").select("field_id", "token")


def _weights(spark: SparkSession, folder: str, scheme: str, field: str | None = None) -> DataFrame:
    postings, stats = _table(spark, folder, "postings"), _table(spark, folder, "field_stats")
    if field:
        postings, stats = postings.where(F.col("field") == field), stats.where(F.col("field") == field)
    return weighting.term_weights(postings, stats, scheme)


def p2_log_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder, "log_entropy").withColumn("weight", F.round("weight", 6))


def p2_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder, "bm25").withColumn("weight", F.round("weight", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return weighting.leading_terms(_weights(spark, folder, "bm25", "title")).select("doc_id", "token")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.encode_corpus(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def p7_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """Texts packed by their length in characters, and what has to hold of any packing: what is in containers of each
    document, in how many parts, and whether all containers with a part of it hold no more than they can."""
    documents, capacity = _table(spark, folder, "documents"), 8_192
    packed = packing.pack_sizes(documents.select(F.col("doc_id").alias("id"), F.length("text").alias("n_tokens")), capacity)
    fill = packed.groupBy("container_id").agg((F.sum("n_tokens") <= capacity).alias("fits"))
    return packed.join(fill, "container_id", "left").groupBy(F.col("id").alias("doc_id")).agg(
        F.sum("n_tokens").alias("n_chars"), F.count("*").alias("n_parts"), F.coalesce(F.bool_and("fits"), F.lit(True)).alias("fits")
    )


def p8_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    measured = repetition.repetition(_table(spark, folder, "documents"))
    return measured.where(F.col("repeated_20") * 10 >= F.col("n_letters") * 3).where("repeated_20 > 0").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_term_counts, p2_found, p2_log_entropy, p2_bm25, p6_ids, p7_containers, p7_by_length, p8_found, p8_repetition)
}
