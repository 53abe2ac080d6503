from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.packing import _packer, pack_block, pack_documents, pack_sizes
from lodestone.llm.tokenizing import VOCABULARY, load


def check(sizes, capacity, container, start):
    """No overlap, nothing over the capacity; the fill of the containers."""
    used = {}
    for s, c, a in sorted(zip(sizes, container, start), key=lambda x: (x[1], x[2])):
        assert a == used.get(c, 0)
        used[c] = a + s
        assert used[c] <= capacity
    return sum(sizes) / (capacity * len(used)) if used else 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.booleans())
def test_any_sizes(sizes, backfill):
    container, start = pack_block(np.array(sizes, dtype=np.int64), 60, backfill)
    check(sizes, 60, container.tolist(), start.tolist())



def test_plain_classes_hold_a_fixed_count():
    sizes = [60, 31, 31, 30, 30, 30, 21, 21, 20, 20, 20]
    container, _ = pack_block(np.array(sizes), 60, backfill=False)
    assert sorted(np.bincount(container).tolist()) == [1, 1, 1, 1, 2, 2, 3]


def test_fill_is_close_to_the_best_possible():
    chooser = np.random.default_rng(1)
    sizes = np.minimum(2_048, chooser.lognormal(6, 1, 50_000).astype(int) + 1)
    filled = check(sizes.tolist(), 2_048, *(x.tolist() for x in pack_block(sizes, 2_048)))
    plain = check(sizes.tolist(), 2_048, *(x.tolist() for x in pack_block(sizes, 2_048, backfill=False)))
    assert filled > 0.99 > plain


def test_sizes_of_all_kinds(spark):
    rows = [(1, 0), (2, None), (3, 100), (4, 101), (5, 250), (None, 7), (None, 7), (6, 33), (6, 33), (6, 34)]
    for block in (2, 1 << 20):
        got = pack_sizes(spark.createDataFrame(rows, "id bigint, n_tokens bigint"), 100, block).collect()
        assert sorted((r.id, r.part, r.token_from, r.n_tokens) for r in got if r.id is not None) == sorted(
            [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 100), (4, 0, 0, 100), (4, 1, 100, 1), (5, 0, 0, 100), (5, 1, 100, 100),
             (5, 2, 200, 50), (6, 0, 0, 33), (6, 0, 0, 33), (6, 0, 0, 34)]
        )
        assert len(got) == 13 and all((r.container_id is None) == (r.n_tokens == 0) for r in got)
        held = [r for r in got if r.n_tokens]
        check([r.n_tokens for r in held], 100, [r.container_id for r in held], [r.start for r in held])


def test_many_copies_of_one_row_are_spread(spark):
    rows = spark.range(200_000).selectExpr("CAST(1 AS BIGINT) AS id", "CAST(3 AS BIGINT) AS n_tokens")
    got = pack_sizes(rows, 9)
    assert got.count() == 200_000
    assert got.groupBy("container_id").count().where("count > 3").count() == 0


def test_memory_does_not_follow_the_parts(monkeypatch):
    """20,000 items of 196 parts each, 3.9 million parts, in one worker; and rows that stand for many copies."""
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 3)))
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(10_000)), "n_tokens": pa.array([400_001] * 10_000), "copies": pa.array([1] * 10_000)})
    many = pa.RecordBatch.from_pydict({"id": pa.array([7, 8]), "n_tokens": pa.array([2_500, 452]), "copies": pa.array([65_536] * 2)})
    tracemalloc.start()
    parts = tokens = 0
    containers = set()
    for out in _packer(2_048, 1 << 16, True)(iter([rows, rows, many])):
        parts, tokens = parts + len(out), tokens + int(out.column(3).to_numpy().sum())
        assert len(out) <= 1 << 17
        first, last = out.column(4).to_numpy().min(), out.column(4).to_numpy().max()
        assert all(last < a or first > b for a, b in containers)
        containers.add((first, last))
    assert parts == 20_000 * 196 + 3 * 65_536 and tokens == 20_000 * 400_001 + 65_536 * 2_952
    assert tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() < 100 << 20
    tracemalloc.stop()


def test_documents(spark):
    texts = ["", None, "a b c " * 900, "short", "short", "x" * 3_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, part int")
    got = pack_documents(df, capacity=256, piece_chars=512).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == {i: len(load(VOCABULARY).encode(t or "")) for i, t in enumerate(texts)}
    assert pack_documents(df.limit(0)).count() == 0


def test_capacity_is_checked(spark):
    with pytest.raises(ValueError):
        pack_sizes(spark.createDataFrame([], "id bigint, n_tokens bigint"), 0)
