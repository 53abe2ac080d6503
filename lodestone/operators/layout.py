"""Statistics of an index, as DataFrames.  They cover the whole index, flushed or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.blocks import DOCS_PER_BLOCK, TOKENS_PER_BLOCK
from lodestone.operators.index import IndexTables, document_frequency

TOP_TOKENS, ANCHORS = 15, 10
#: Bytes that one entry of the length statistics takes in memory, for the estimate of the page (fixed value).
STAT_BYTES = 56


def field_lengths(stats: DataFrame) -> DataFrame:
    """``(field, docs, total_tokens, avgdl, bytes)`` per field, and a row with null field over all."""
    return (
        stats.rollup("field")
        .agg(
            F.count("*").alias("docs"),
            F.sum("total_tokens").cast("bigint").alias("total_tokens"),
            F.round(F.avg("total_tokens"), 6).alias("avgdl"),
        )
        .withColumn("bytes", F.col("docs") * STAT_BYTES)
    )


def entry_counts(index: IndexTables) -> DataFrame:
    """One row: documents, fields with postings, distinct terms, postings."""
    terms = document_frequency(index.postings).agg(
        F.countDistinct("field").alias("fields"), F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("bigint").alias("postings")
    )
    docs = index.docs.agg(F.count("*").alias("documents"))
    return docs.withColumn("one", F.lit(1)).join(terms.withColumn("one", F.lit(1)), "one").drop("one")


def field_terms(postings: DataFrame) -> DataFrame:
    """``(field, tokens, postings, max_df, most_common)``; of several tokens with the greatest df the smallest."""
    return (
        document_frequency(postings)
        .groupBy("field")
        .agg(
            F.count("*").alias("tokens"),
            F.sum("df").cast("bigint").alias("postings"),
            F.max("df").alias("max_df"),
            F.min(F.struct(-F.col("df"), "token"))["token"].alias("most_common"),
        )
    )


def top_tokens(postings: DataFrame, limit: int = TOP_TOKENS) -> DataFrame:
    """The terms in most documents; ties by field, then token."""
    return document_frequency(postings).orderBy(F.col("df").desc(), "field", "token").limit(limit)


def _of_all(parts: dict[str, DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    named = [df.select(F.lit(s).alias("segment"), "*") for s, df in parts.items()]
    return reduce(DataFrame.unionByName, named) if named else spark.createDataFrame([], f"segment string, {schema}")


def last_documents(docs: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """``(segment, max_doc_id)``."""
    return _of_all({s: df.agg(F.max("doc_id").alias("max_doc_id")) for s, df in docs.items()}, spark, "max_doc_id bigint")


def segment_terms(postings: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """``(segment, field, token)`` of the postings of a few segments that are stored apart."""
    return _of_all({s: df.select("field", "token") for s, df in postings.items()}, spark, "field string, token string")


def term_anchors(postings: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """``(segment, block, field, token)`` of ``postings(segment, field, token)``: where the first blocks of each segment's
    sorted terms begin.  The plan is the same for any number of segments; each task keeps only the terms of those blocks
    before the rows of a segment meet, so a large segment does not fill one task."""
    in_order = Window.partitionBy("segment").orderBy(F.asc_nulls_last("field"), "token")
    placed = postings.select("segment", "field", "token").distinct().withColumn("at", F.row_number().over(in_order))
    begins = placed.where((F.col("at") <= anchors * TOKENS_PER_BLOCK) & ((F.col("at") - 1) % TOKENS_PER_BLOCK == 0))
    return begins.select(
        F.col("segment").cast("string").alias("segment"), ((F.col("at") - 1) / TOKENS_PER_BLOCK).cast("int").alias("block"), "field", "token"
    )


def doc_anchors(docs: dict[str, DataFrame], spark: SparkSession, anchors: int = ANCHORS) -> DataFrame:
    """``(segment, block, doc_id)``: where the first blocks of each segment's documents begin."""
    first = F.row_number().over(Window.partitionBy("one").orderBy("doc_id")) - 1

    def of(df: DataFrame) -> DataFrame:
        few = df.select("doc_id").orderBy("doc_id").limit(anchors * DOCS_PER_BLOCK)
        placed = few.withColumn("one", F.lit(1)).withColumn("at", first).where(F.col("at") % DOCS_PER_BLOCK == 0)
        return placed.select((F.col("at") / DOCS_PER_BLOCK).cast("int").alias("block"), "doc_id")

    return _of_all({s: of(df) for s, df in docs.items()}, spark, "block int, doc_id bigint")
