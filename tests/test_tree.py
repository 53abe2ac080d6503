from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators.tree import MOST_CHUNKS, chunk_count, frequent_terms, rounds_of, stored_rows, term_statistics, tree_aggregate, tree_levels

POSTINGS = "segment_id int, field string, token string, doc_id bigint, tf int, dl int"


@pytest.mark.parametrize("fan_in,chunks", [(2, 1), (2, 64), (3, 10_000), (32, None)])
def test_equals_a_plain_aggregation(spark, fan_in, chunks):
    chooser = random.Random(5)
    rows = [(chooser.choice(["hot"] * 9 + ["a", "b", None]), chooser.choice([1, 2, None]), chooser.randint(-5, 5)) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "chunk string, k1 int, s0 int").repartition(13)
    got = tree_aggregate(df, ["chunk", "k1"], {"n": ("sum", F.lit(1)), "lo": ("min", F.col("s0")), "hi": ("max", F.col("s0"))}, fan_in, chunks)
    plain = df.groupBy("chunk", "k1").agg(F.sum(F.lit(1)).alias("n"), F.min("s0").alias("lo"), F.max("s0").alias("hi"))
    assert got.columns == plain.columns and sorted(got.collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert tree_aggregate(df.limit(0), ["k1"], {"n": ("sum", F.lit(1))}, fan_in, chunks).count() == 0


def test_no_task_gets_more_than_fan_in_states(spark, tmp_path):
    """400 small files, each a task of its own, all with rows of one key."""
    spark.range(0, 4_000, 1, 400).select(F.lit("hot").alias("k")).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for name in ("openCostInBytes", "maxPartitionBytes"):
            spark.conf.set(f"spark.sql.files.{name}", "2000")
        df = spark.read.parquet(str(tmp_path / "t"))
        assert chunk_count(df) == df.rdd.getNumPartitions() >= 400
        measure = {"n": ("sum", F.lit(1))}
        for fan_in, rounds in ((32, 2), (8, 3)):
            states = df.groupBy("k", F.spark_partition_id().alias("_chunk")).count()
            levels = list(tree_levels(df, ["k"], measure, fan_in))
            assert len(levels) == rounds
            widths = rounds_of(chunk_count(df), fan_in)
            for level, width in zip(levels, widths):
                received = states.groupBy("k", F.expr(f"_chunk div {width}")).count().agg(F.max("count")).first()[0]
                assert received <= width <= fan_in
                states = level
            assert [tuple(r) for r in states.select("k", "n").collect()] == [("hot", 4_000)]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])


def test_number_of_chunks(spark):
    df = spark.range(0, 640, 1, 64).withColumn("k", F.col("id") % 3)
    assert chunk_count(df) == 64
    assert chunk_count(df.groupBy("k").count()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert chunk_count(df.join(df, "id")) == MOST_CHUNKS
    assert [len(rounds_of(n, 32)) for n in (1, 2, 32, 33, 1_024, 1_025, 1 << 20)] == [1, 2, 2, 2, 2, 3, 4]
    assert all(w <= 32 and w ** len(ws) >= n for n in (1, 2, 7, 33, 999, 5_000, 1 << 20) for ws in [rounds_of(n, 32)] for w in ws)


def test_rows_are_read_once(spark, tmp_path):
    spark.createDataFrame(ROWS, POSTINGS).write.parquet(str(tmp_path / "p"))
    df = frequent_terms(spark.read.parquet(str(tmp_path / "p")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert "ReusedExchange" in final


def test_arguments(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        tree_aggregate(df, ["id"], {"n": ("avg", F.col("id"))})
    with pytest.raises(ValueError):
        tree_aggregate(df, ["id"], {}, 1)


ROWS = [
    (1, "t", "Milch ", 1, 2, 0), (2, "t", "milch", 1, 5, 0), (2, "t", "milch", 1, 5, 0), (1, "t", "milch", 2, 1, 0),
    (1, "t", "milch", None, 1, 0), (1, "t", "milch", 3, None, 0), (1, "t", "nodoc", None, None, 0), (None, "t", "bio", 1, 1, 0),
    (1, "t", None, 1, 1, 0), (1, "t", " ", 1, 1, 0), (1, None, "x", 1, 1, 0), (1, "k", "milch", 1, 1, 0),
]


def test_term_statistics(spark):
    df = spark.createDataFrame(ROWS, POSTINGS).withColumn("n_rows", F.lit("clash"))
    got = {(r.field, r.token): tuple(r)[2:] for r in term_statistics(df).collect()}
    assert got == {("t", "milch"): (6, 2, 6, 5), ("t", "nodoc"): (1, 0, None, None), ("t", "bio"): (1, 1, 1, 1), ("k", "milch"): (1, 1, 1, 1)}
    counts = Counter((f, t.strip().lower()) for _, f, t, *_ in ROWS if f and t and t.strip())
    assert {(r.field, r.token): r.n_rows for r in stored_rows(df).collect() if r.field and r.token} == counts
    assert sum(r.n_rows for r in stored_rows(df).collect()) == len(ROWS)


def test_share_is_exact(spark):
    rows = [(1, "t", "edge", 1, 1, 0)] * 7 + [(1, "t", "below", 1, 1, 0)] * 6 + [(1, "t", f"x{i}", i, 1, 0) for i in range(680)] + [(1, "t", None, 1, 1, 0)] * 7
    found = frequent_terms(spark.createDataFrame(rows, POSTINGS)).collect()
    assert [(r.token, r.n_rows) for r in found] == [("edge", 7)]
    assert frequent_terms(spark.createDataFrame([], POSTINGS)).count() == 0
