from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions.newest import Newest
from lodestone.operators import blocks
from lodestone.session import checkpoint_folder, checkpointed, hot_parts, small_side


def test_blocks(spark):
    chooser = random.Random(3)
    rows = sorted({(chooser.choice("kt"), f"w{chooser.randint(0, 60)}", chooser.randint(0, 400_000)) for _ in range(900)} | {("t", "hot", i * 977) for i in range(400)})
    df = spark.createDataFrame(rows, "field string, token string, doc_id bigint").repartition(5)
    docs = defaultdict(list)
    for f, t, d in rows:
        docs[f, t].append(d)
    expected = {(f, t, d, d - p) for (f, t), ds in docs.items() for p, d in zip([0, *ds], ds)}
    assert {tuple(r) for r in blocks.delta_postings(df).collect()} == expected
    decoded = blocks.decode_postings(blocks.delta_entries(df).drop("doc_id"), 7).collect()
    assert {(r.field, r.token, r.place, r.doc_id) for r in decoded} == {(f, t, i, d) for (f, t), ds in docs.items() for i, d in enumerate(ds)}
    found = {}
    for f in "kt":
        own = sorted(t for g, t in docs if g == f)
        for i in range(0, len(own), 16):
            part = own[i : i + 16]
            found[f, i // 16] = (part[0], len(part), sum(len(docs[f, t]) for t in part))
    made = blocks.token_blocks(df)
    assert {(r.field, r.block): (r.first_token, r.n_tokens, r.n_postings) for r in made.collect()} == found
    got = {(r.field, r.token): r.block for r in blocks.block_of_tokens(made, ["w3", "a", "zzz", "w3"]).collect()}
    assert got == {(f, t): b for f in "kt" for t in ("w3", "zzz") if (b := max((b for (g, b), x in found.items() if g == f and x[0] <= t), default=None)) is not None}
    ids = sorted({d for _, _, d in rows})
    assert {(r.block, r.first_doc, r.last_doc, r.n_docs) for r in blocks.doc_blocks(df.select("doc_id").distinct()).collect()} == {
        (i // 128, ids[i], ids[min(i + 127, len(ids) - 1)], len(ids[i : i + 128])) for i in range(0, len(ids), 128)
    }
    for empty in (blocks.delta_postings(df.limit(0)), blocks.token_blocks(df.limit(0)), blocks.doc_blocks(df.select("doc_id").limit(0))):
        assert empty.count() == 0


def test_nothing_is_gathered_in_one_task(spark, tmp_path):
    """Ids that are hashes of 64 bits: no task gets all of them, and no block is compared with all tokens."""
    ids = spark.range(5_000).select(F.lit("t").alias("field"), F.lit("hot").alias("token"), F.xxhash64("id").alias("doc_id"))
    made = blocks.doc_blocks(ids)
    assert [r.n_docs for r in made.orderBy("block").collect()] == [128] * 39 + [8]
    entries = blocks.delta_entries(ids)
    assert entries.where("place > 0 AND delta <= 0").count() == 0 and entries.count() == 5_000
    assert blocks.decode_postings(entries, 100).join(ids, "doc_id").count() == 5_000
    found = blocks.block_of_tokens(spark.createDataFrame([("t", "b", 0), ("t", "m", 1)], "field string, first_token string, block int"), ["a", "b", "z"])
    assert {tuple(r) for r in found.collect()} == {("t", "b", 0), ("t", "z", 1)}
    for df in (made, entries, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "SinglePartition" not in plan


def test_numbers_as_bytes(spark):
    numbers = [0, 1, 127, 128, 300, 16_383, 16_384, 2**31, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", blocks.varint(F.col("n")).alias("b"))
    got = {r.n: bytes(r.b) for r in df.collect()}
    assert got[300] == b"\xac\x02" and got[0] == b"\x00" and len(got[2**63 - 1]) == 9
    assert all(r.n == r.m for r in df.select("n", blocks.from_varint(F.col("b")).alias("m")).collect())
    assert spark.range(1).select(blocks.varint(F.lit(-1).cast("bigint")).alias("x")).first().x is None


@pytest.mark.parametrize("types", ["int", "bigint"])
def test_newest(spark, types):
    rows = [(1, 1, 5), (1, 2, 3), (1, 2, 4), (2, None, 7), (2, -5, 1), (3, None, 1), (3, None, -9), (4, 3, None), (4, 2, 8), (5, 2**31 - 1, -(2**31)), (5, 0, 2**31 - 1)]
    df = spark.createDataFrame(rows, f"k int, o {types}, v {types}")
    newest = Newest(df.schema["o"].dataType, df.schema["v"].dataType)
    got = df.groupBy("k").agg(newest.value(F.max(newest.key(F.col("o"), F.col("v")))).alias("v"))
    assert {r.k: r.v for r in got.collect()} == {1: 4, 2: 1, 3: 1, 4: 8, 5: -(2**31)}
    assert newest.packed is (types == "int")


def test_session_helpers(spark):
    df = spark.range(10)
    assert small_side(df, 10).count() == small_side(df, 9).count() == 10
    assert hot_parts(spark) == 64
    assert checkpointed(df).count() == 10 and checkpoint_folder(spark) == checkpoint_folder(spark)
