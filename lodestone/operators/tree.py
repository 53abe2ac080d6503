"""Per-key results when a few keys hold most rows: aggregation over a tree.

Each input chunk (the rows of one input task, whose size Spark fixes) is combined where it is read, so a key leaves a
chunk as one state, however many rows it has there.  States of ``fan_in`` neighbouring chunks are then merged, those of
``fan_in`` such groups next, and so on: no task receives more than ``fan_in`` states of a key, and the number of rounds
is the logarithm of the number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analyze import clean_term
from lodestone.functions.newest import Newest

FAN_IN = 32
#: Chunks that are assumed where their number cannot be told before the plan runs.
MOST_CHUNKS = 1 << 20
_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def chunk_count(rows: DataFrame) -> int:
    """How many tasks read ``rows``, or a number that is not less.

    A plan that exchanges nothing is asked for its partitions, which plans the files of its scans and runs no job.  One
    that ends in an exchange without joins has at most the partitions of that exchange.  Of any other plan nothing is
    known: :data:`MOST_CHUNKS`.
    """
    try:
        physical = rows._jdf.queryExecution().executedPlan()
        text = physical.toString()
        if not any(word in text for word in ("Exchange", "AdaptiveSparkPlan", "Subquery")):
            return max(1, rows._jdf.queryExecution().toRdd().getNumPartitions())
        if physical.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and "Join" not in text:
            partitions = physical.initialPlan().outputPartitioning().numPartitions()
            return partitions if partitions > 0 else MOST_CHUNKS
    except AttributeError:  # a client that has no plan at hand
        pass
    return MOST_CHUNKS


def rounds_of(chunks: int, fan_in: int) -> list[int]:
    """The fan-in of each round: as few rounds as ``fan_in`` allows, but two at least where there are several chunks, and
    all of them alike."""
    rounds, reached = 1, fan_in
    while reached < chunks:
        rounds, reached = rounds + 1, reached * fan_in
    rounds = max(rounds, 2 if chunks > 1 else 1)
    width = 2
    while width**rounds < chunks:
        width += 1
    return [width] * rounds


def tree_levels(
    rows: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, Column]],
    fan_in: int = FAN_IN,
    chunks: int | None = None,
) -> Iterator[DataFrame]:
    """The states after each round, the last with one per key; columns as in the result of :func:`tree_aggregate`, and
    ``_chunk``, the group of chunks that a state stands for."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    if unknown := {how for how, _ in measures.values()} - set(_MERGES):
        raise ValueError(f"cannot merge by {', '.join(sorted(unknown))}")
    names = [f"k{i}" for i in range(len(keys))]
    states = [f"s{i}" for i in range(len(measures))]
    out = rows.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)),
        *(value.alias(s) for (_, value), s in zip(measures.values(), states)),
        F.spark_partition_id().alias("chunk"),
    )
    merge = [_MERGES[how](s).alias(s) for (how, _), s in zip(measures.values(), states)]
    widths = rounds_of(chunks or chunk_count(rows), fan_in)
    for k, width in enumerate(widths):
        last = k + 1 == len(widths)
        out = out.groupBy(*names, *([] if last else [F.expr(f"chunk div {width}").alias("chunk")])).agg(*merge)
        yield out.select(
            *(F.col(n).alias(k) for k, n in zip(keys, names)),
            *(F.col(s).alias(m) for m, s in zip(measures, states)),
            (F.lit(0) if last else F.col("chunk")).alias("_chunk"),
        )


def tree_aggregate(
    rows: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, Column]],
    fan_in: int = FAN_IN,
    chunks: int | None = None,
) -> DataFrame:
    """``keys`` and one column per measure: ``{"n": ("sum", F.lit(1)), "last": ("max", F.col("ts"))}``.

    Results equal those of ``groupBy(keys)``: nulls are keys of their own, nulls are skipped by the measures, an empty
    table has no rows, further columns are not read.  Measures are merged by ``sum``, ``min`` or ``max``.  ``chunks`` is
    the number of input tasks if it is known, else :func:`chunk_count` finds it.
    """
    *_, last = tree_levels(rows, keys, measures, fan_in, chunks)
    return last.select(*keys, *measures)


def stored_rows(postings: DataFrame, fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """``(field, token, n_rows)``: the rows of each term as stored, with replays and rows that lack a document.  Rows that
    name no term are counted under a null field or token."""
    rows = postings.select("field", clean_term(F.col("token")).alias("token"))
    return tree_aggregate(rows, ["field", "token"], {"n_rows": ("sum", F.lit(1).cast("bigint"))}, fan_in, chunks)


def frequent_terms(postings: DataFrame, share: float = 0.01, fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """``(field, token, n_rows)`` of terms with at least ``share`` of all rows of ``postings``, those that name no term
    included in the total.  The total is the sum over the tree's last level, so the rows are read once."""
    part = Fraction(str(share))
    counts = stored_rows(postings, fan_in, chunks)
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    # One condition on the count: one on the keys alone would be moved below the tree, which then would be run twice.
    named = F.when(F.col("field").isNotNull() & F.col("token").isNotNull(), F.col("n_rows"))
    return counts.where(named * part.denominator >= total * part.numerator)


def term_statistics(postings: DataFrame, fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """``(field, token, n_rows, n_docs, total_tf, max_tf)`` per term of ``postings``.

    ``n_rows`` counts rows as stored; the other columns take, for each document, the row with the highest segment (of
    several there the greatest tf), and leave out rows without a document or frequency: a term that has no others has
    ``n_docs`` 0 and null for the rest.  Rows without a field or term are left out.
    """
    rows = postings.select("field", clean_term(F.col("token")).alias("token"), "doc_id", "segment_id", "tf")
    newest = Newest(rows.schema["segment_id"].dataType, rows.schema["tf"].dataType)
    key = F.when(F.col("doc_id").isNotNull(), newest.key(F.col("segment_id"), F.col("tf")))
    by_doc = (
        rows.where("token IS NOT NULL AND field IS NOT NULL")
        .groupBy("field", "token", "doc_id")
        .agg(F.count("*").alias("n"), newest.value(F.max(key)).cast("bigint").alias("tf"))
    )
    return tree_aggregate(
        by_doc,
        ["field", "token"],
        {
            "n_rows": ("sum", F.col("n")),
            "n_docs": ("sum", F.col("tf").isNotNull().cast("bigint")),
            "total_tf": ("sum", F.col("tf")),
            "max_tf": ("max", F.col("tf")),
        },
        fan_in,
        chunks,
    )
