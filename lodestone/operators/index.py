"""Building the tables of an index from documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analyze import keyword, tokens, trigrams
from lodestone.mapping import Mapping
from lodestone.session import checkpointed, local_table

#: Sort order of each stored table: a lookup by its first columns reads few row groups.
ORDER = {"docs": ["doc_id"], "postings": ["token", "field", "doc_id"], "field_stats": ["field", "doc_id"], "trigrams": ["trigram", "field"], "grams": ["trigram", "field", "token"]}


@dataclass(frozen=True)
class IndexTables:
    """An index as DataFrames.

    ``docs(doc_id, doc)``, ``postings(field, token, doc_id, tf, dl)``, ``field_stats(field, doc_id, total_tokens)``,
    ``trigrams(field, trigram, token, doc_id, pos)`` with the first token that had each trigram,
    ``grams(field, trigram, token)`` with every one, and ``lengths(field, n_docs, total_tokens)``, one row per field.
    """

    docs: DataFrame
    postings: DataFrame
    field_stats: DataFrame
    trigrams: DataFrame
    grams: DataFrame
    lengths: DataFrame

    def union(self, other: IndexTables) -> IndexTables:
        """Of two indexes without common documents; a trigram that both have keeps the token of the earlier document."""
        both = {x.name: getattr(self, x.name).unionByName(getattr(other, x.name)) for x in fields(self)}
        both["trigrams"] = first_tokens(both["trigrams"])
        both["grams"] = both["grams"].distinct()
        both["lengths"] = total_lengths(both["lengths"])
        return IndexTables(**both)


def analyzed(docs: DataFrame, mapping: Mapping) -> DataFrame:
    """``(doc_id, field, tokens)``: one row per document and indexed field that has a value."""
    cells = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.when(F.col("doc")[f.name].isNotNull(), (tokens if f.s_type == "Text" else keyword)(F.col("doc")[f.name])).alias("tokens"),
        )
        for f in mapping.indexed
    ]
    if not cells:
        return docs.select("doc_id", F.lit("").alias("field"), F.array().cast("array<string>").alias("tokens")).limit(0)
    return docs.select("doc_id", F.inline(F.array(*cells))).where("tokens IS NOT NULL")


def field_stats(fields_of_docs: DataFrame) -> DataFrame:
    """Length of each field of each document, also of those without a token."""
    return fields_of_docs.select("field", "doc_id", F.size("tokens").alias("total_tokens"))


def placed_tokens(fields_of_docs: DataFrame) -> DataFrame:
    """``(field, token, doc_id, tf, dl, pos)``: postings with the first place of the token in the field.  The key holds
    the document, so no token can fill one task.  A field without tokens leaves one row, with a null token, at place 0."""
    opened = fields_of_docs.select("field", "doc_id", F.size("tokens").alias("dl"), F.posexplode_outer("tokens").alias("pos", "token"))
    return (
        opened.groupBy("field", "token", "doc_id")
        .agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"), F.coalesce(F.min("pos"), F.lit(0)).alias("pos"))
    )


def postings(fields_of_docs: DataFrame) -> DataFrame:
    """``(field, token, doc_id, tf, dl)``."""
    return placed_tokens(fields_of_docs).where("token IS NOT NULL").drop("pos")


def first_tokens(grams: DataFrame) -> DataFrame:
    """Per field and trigram the token of the first document (and first place in it) that had it."""
    place = F.struct("doc_id", "pos", "token")
    return (
        grams.groupBy("field", "trigram")
        .agg(F.min(place).alias("first"))
        .select("field", "trigram", "first.token", "first.doc_id", "first.pos")
    )


def build(docs: DataFrame, mapping: Mapping, stage: Callable[[DataFrame], DataFrame] | None = None) -> IndexTables:
    """The tables of an index over ``docs(doc_id, doc)``.  Text fields give their tokens, Keyword fields one token, other
    fields nothing; a null field gives nothing at all.  ``stage`` may write what all tables but ``docs`` are made of, so
    that the texts are analyzed once."""
    cells = analyzed(docs, mapping)
    placed = placed_tokens(cells)
    stats = field_stats(cells)
    if stage:
        placed = stage(placed)
        # Exactly one token of a field is its first, and a field without tokens has its row at place 0.
        stats = placed.where("pos = 0").select("field", "doc_id", F.col("dl").alias("total_tokens"))
    placed = placed.where("token IS NOT NULL")
    # A token has the same trigrams wherever it is: reduce to first places of tokens before trigrams multiply the rows.
    tokens_first = placed.groupBy("field", "token").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    grams = tokens_first.select(
        "field", "token", "first.doc_id", "first.pos", F.explode(F.array_distinct(trigrams(F.col("token")))).alias("trigram")
    )
    return IndexTables(
        docs=docs.select("doc_id", "doc"),
        postings=placed.drop("pos"),
        field_stats=stats,
        trigrams=first_tokens(grams).select("field", "trigram", "token", "doc_id", "pos"),
        grams=grams.select("field", "trigram", "token"),
        lengths=field_lengths(stats),
    )


def field_lengths(stats: DataFrame) -> DataFrame:
    """``(field, n_docs, total_tokens)`` of ``field_stats``."""
    return stats.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("total_tokens").cast("bigint").alias("total_tokens"))


def total_lengths(lengths: DataFrame) -> DataFrame:
    """The same of several parts together."""
    return lengths.groupBy("field").agg(F.sum("n_docs").cast("bigint").alias("n_docs"), F.sum("total_tokens").cast("bigint").alias("total_tokens"))


def field_aggregates(lengths: DataFrame) -> DataFrame:
    """``(field, n_docs, avgdl)``: what the ranking needs to know of a field."""
    return lengths.select("field", "n_docs", (F.col("total_tokens") / F.col("n_docs")).alias("avgdl"))


def document_frequency(index_postings: DataFrame) -> DataFrame:
    return index_postings.groupBy("field", "token").agg(F.count("*").alias("df"))


def number_documents(rows: DataFrame, last_id: int, order: list[str]) -> DataFrame:
    """``rows`` with ``doc_id`` from ``last_id + 1`` on, without gaps, in the given order.

    Rows are range-partitioned by the order and written to the checkpoint folder, as ranges are drawn anew in each run
    of a plan; each task's count (one number) then gives the next task its first number.  Nothing is gathered in one
    task.  Rows that are equal in the order take any of their numbers.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = checkpointed(ranged).withColumn("_part", F.spark_partition_id())
    numbered = fixed.withColumn("_seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    begin, starts = last_id + 1, []
    for part in sorted(counts):
        starts.append((part, begin))
        begin += counts[part]
    offsets = local_table(spark, starts or [(0, begin)], "_part int, _start bigint")
    return (
        numbered.join(F.broadcast(offsets), "_part")  # one row a task
        .withColumn("doc_id", F.col("_start") + F.col("_seq"))
        .drop("_part", "_seq", "_start")
    )
