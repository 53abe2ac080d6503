"""Blocks of sorted entries: what an index file stores beside the entries to find and pack them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.index import number_documents
from lodestone.session import checkpointed, local_table, small_side

TOKENS_PER_BLOCK, DOCS_PER_BLOCK = 16, 128
#: Entries of a term that are added up in one task.
CHUNK = 1 << 16
#: Up to this many fields are broadcast; a mapping has a few.
FIELDS = 10_000


def delta_entries(postings: DataFrame) -> DataFrame:
    """``(field, token, place, doc_id, delta)``: the documents of each term from place 0 on, with the gap to the one before,
    of the first one the id itself.

    Ids are cut into ranges of like many rows, whatever the ids are, so a frequent term fills many tasks and has at most
    one row a range where the last document of each range is carried to the next.  The ranges are drawn once and kept in
    the checkpoint folder.
    """
    key = ["field", "token", "range"]
    cut = checkpointed(postings.select("field", "token", "doc_id").repartitionByRange("doc_id"))
    ranged = cut.withColumn("range", F.spark_partition_id())
    ends = ranged.groupBy(*key).agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
    by_term = Window.partitionBy("field", "token").orderBy("range")
    earlier = F.coalesce(F.sum("n").over(by_term.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ends.select(*key, F.lag("last", 1, 0).over(by_term).alias("before"), earlier.alias("earlier"))
    in_range = Window.partitionBy(*key).orderBy("doc_id")
    gap = F.lag("doc_id").over(in_range)
    placed = ranged.select(*key, "doc_id", gap.alias("gap"), F.row_number().over(in_range).alias("k"))
    return placed.join(before, key).select(
        "field", "token", (F.col("earlier") + F.col("k") - 1).alias("place"), "doc_id", (F.col("doc_id") - F.coalesce("gap", "before")).alias("delta")
    )


def delta_postings(postings: DataFrame) -> DataFrame:
    """``(field, token, doc_id, delta)``, see :func:`delta_entries`."""
    return delta_entries(postings).drop("place")


def decode_postings(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(field, token, place, doc_id)`` of ``entries(field, token, place, delta)``: the sums of the gaps, taken by chunks of a
    term and carried from chunk to chunk."""
    key = ["field", "token", "chunk"]
    cut = entries.select("field", "token", "place", "delta", F.expr(f"place div {chunk}").alias("chunk"))
    sums = cut.groupBy(*key).agg(F.sum("delta").alias("s"))
    by_term = Window.partitionBy("field", "token").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, F.coalesce(F.sum("s").over(by_term), F.lit(0)).alias("before"))
    so_far = F.sum("delta").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return cut.select(*key, "place", so_far.alias("so_far")).join(before, key).select("field", "token", "place", (F.col("before") + F.col("so_far")).alias("doc_id"))


def varint(value: Column) -> Column:
    """A number that is not negative as binary: seven bits a byte, the lowest first, the high bit set on all but the last."""
    digits = []
    for k in range(9):
        rest = F.shiftrightunsigned(value, 7 * k)
        byte = rest.bitwiseAND(127) + F.when(F.shiftrightunsigned(value, 7 * k + 7) > 0, 128).otherwise(0)
        digits.append(F.when((rest > 0) | F.lit(k == 0), F.lpad(F.hex(byte), 2, "0")).otherwise(""))
    return F.when(value >= 0, F.unhex(F.concat(*digits)))


def from_varint(encoded: Column) -> Column:
    """The number that :func:`varint` has encoded."""
    text = F.hex(encoded)
    places = F.sequence(F.lit(0), F.length(encoded) - 1)
    byte = lambda k: F.conv(F.substring(text, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseAND(127)
    power = F.array(*(F.lit(1 << 7 * k).cast("bigint") for k in range(9)))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda so_far, k: so_far + byte(k) * F.get(power, k))


def block_locations(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """``(section, block, offset, length)`` of ``blocks(section, block, offset)``, numbered without gaps: a block ends where
    the next one begins, the last one with its section, ``sections(section, size)``."""
    following = blocks.select("section", (F.col("block") - 1).alias("block"), F.col("offset").alias("end"))
    ends = blocks.join(following, ["section", "block"], "left").join(small_side(sections, FIELDS), "section")
    return ends.select("section", "block", "offset", (F.coalesce("end", "size") - F.col("offset")).alias("length"))


def token_blocks(postings: DataFrame, size: int = TOKENS_PER_BLOCK) -> DataFrame:
    """``(field, block, first_token, n_tokens, n_postings)``: the sorted terms of a field in blocks of ``size``.  Terms are
    numbered task by task, see :func:`lodestone.operators.index.number_documents`."""
    terms = number_documents(postings.groupBy("field", "token").agg(F.count("*").alias("df")), 0, ["field", "token"])
    starts = small_side(terms.groupBy("field").agg(F.min("doc_id").alias("start")), FIELDS)
    return (
        terms.join(starts, "field")
        .withColumn("block", F.floor((F.col("doc_id") - F.col("start")) / size))
        .groupBy("field", "block")
        .agg(F.min("token").alias("first_token"), F.count("*").alias("n_tokens"), F.sum("df").cast("bigint").alias("n_postings"))
    )


def doc_blocks(docs: DataFrame, size: int = DOCS_PER_BLOCK) -> DataFrame:
    """``(block, first_doc, last_doc, n_docs)``: documents by id in blocks of ``size``.  They are numbered task by task."""
    placed = number_documents(docs.select(F.col("doc_id").alias("id")), -1, ["id"])
    return (
        placed.groupBy(F.floor(F.col("doc_id") / size).alias("block"))
        .agg(F.min("id").alias("first_doc"), F.max("id").alias("last_doc"), F.count("*").alias("n_docs"))
    )


def block_of_tokens(blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """``(field, token, block)``: the block in which a token would be, that is the last one that begins at or before it;
    tokens before all blocks of a field have no row for it.

    Each block looks up its place among the sorted tokens of the query and the last block of each place is kept, so at
    most one row a token and field leaves a task.
    """
    asked = sorted(set(tokens))

    def places(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sorted_tokens = np.array(asked, dtype=object)
        for batch in batches:
            first = np.array(batch.column(1).to_pylist(), dtype=object)
            at = np.searchsorted(sorted_tokens, first) if len(first) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), batch.column(2)], names=["field", "at", "block"])

    placed = blocks.select("field", "first_token", F.col("block").cast("bigint").alias("block")).mapInArrow(places, "field string, at int, block bigint")
    last = placed.where(F.col("at") < len(asked)).groupBy("field", "at").agg(F.max("block").alias("block"))
    in_order = Window.partitionBy("field").orderBy("at")  # as many rows as tokens were asked for
    reach = last.select("field", "at", F.max("block").over(in_order).alias("block"), F.lead("at", 1, len(asked)).over(in_order).alias("end"))
    names = local_table(blocks.sparkSession, list(enumerate(asked)), "at int, token string")
    spread = reach.select("field", "block", F.explode(F.sequence("at", F.col("end") - 1)).alias("at"))
    return spread.join(F.broadcast(names), "at").select("field", "token", "block")  # the query's own tokens
