from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm.frequency import term_counts, term_marks
from lodestone.llm.weighting import leading_terms, term_weights

ENTRIES = "segment_id int, field_id int, token string, posting_count int, docs array<struct<doc_id:bigint,tf:int>>"
POSTINGS = "segment_id int, field string, token string, doc_id bigint, tf int, dl int"
STATS = "segment_id int, field string, doc_id bigint, total_tokens int"


def brute_counts(rows):
    current = {}
    for segment, field, token, _, docs in rows:
        token = (token or "").strip().lower()
        if field is None or not token or not docs:
            continue
        for doc, tf in docs:
            if doc is not None:
                key, new = (field, token, doc), (-1 if segment is None else segment, tf or 0)
                current[key] = max(current.get(key, new), new)
    total, n = Counter(), Counter()
    for (field, token, _), (_, tf) in current.items():
        total[field, token] += tf
        n[field, token] += 1
    return {k: (total[k], n[k]) for k in n}


ROWS = [
    (1, 3, "Milch ", 9, [(1, 1), (2, 1), (None, 5)]), (2, 3, " milch", None, [(2, 4), (70_000, 1)]),
    (None, 3, "milch", 0, [(1, 9), (3, None)]), (2, 3, "milch", 1, [(2, 4)]), (1, 3, " \t", 1, [(1, 1)]),
    (1, 3, None, 1, [(9, 1)]), (1, 3, "brot", 1, None), (1, 3, "brot", 1, []), (1, None, "brot", 1, [(1, 1)]),
    (1, 0, "milch", 1, [(5, 2)]), (1, 3, "salz", 1, [(-4, 1)]),
]


@pytest.mark.parametrize("heavy_parts,cells", [(1, 1), (2, 3), (512, 1 << 20), (1_000_000, 1)])
def test_counts_do_not_depend_on_the_way_a_term_takes(spark, heavy_parts, cells):
    rows = ROWS + [(s, 3, "hot", 1, [(i * 40_000 % 977, s) for i in range(k, 300, 7)]) for s in (1, 2, 3) for k in (0, 3)]
    got = term_counts(spark.createDataFrame(rows, ENTRIES).repartition(3), heavy_parts, cells).collect()
    assert {(r.field_id, r.token): (r.total_tf, r.n_docs) for r in got} == brute_counts(rows)
    assert len(got) == len(brute_counts(rows))


def test_marks(spark):
    rows = [(1, 3, "a", 1, [(i, 1) for i in range(10)]), (1, 3, "b", 1, [(1, 1), (2, 1)]), (1, 3, "c", 1, [(1, 1)]), (1, 3, "d", 1, [(1, 1), (2, 1), (3, 1)])]
    got = term_marks(spark.createDataFrame(rows, ENTRIES).withColumn("mark", F.lit(1)))
    assert {r.token: (r.field_docs, r.mark) for r in got.collect()} == {"a": (10, "common"), "b": (10, None), "c": (10, "rare"), "d": (10, "common")}


def test_empty_entries(spark):
    assert term_marks(spark.createDataFrame([], ENTRIES)).count() == 0


def weights(spark, postings, stats, *args, **more):
    frames = spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(stats, STATS)
    return term_weights(*frames, *args, **more)


PROWS = [
    (1, "title", "Milch", 1, 2, 0), (2, "title", "milch ", 1, 3, None), (1, "title", "milch", 2, 1, 1), (1, "title", "bio", 1, 1, 1),
    (1, "title", "bio", 2, 1, 1), (1, "title", "bio", 3, 1, 1), (1, "title", None, 3, 1, 1), (1, "title", "x", None, 1, 1),
    (1, "title", "x", 1, None, 1), (1, "title", " ", 1, 1, 1), (1, "category", "milch", 1, 1, 1), (1, "title", "bio", 3, 1, 1),
]
SROWS = [(1, "title", 1, 9), (2, "title", 1, 4), (1, "title", 2, 2), (1, "title", 3, None), (1, "title", 4, 0), (1, "category", 1, 1)]


@pytest.mark.parametrize("heavy_parts", [1, 2, 512])
def test_bm25(spark, heavy_parts):
    got = {(r.field, r.token, r.doc_id): r.weight for r in weights(spark, PROWS, SROWS, "bm25", heavy_parts=heavy_parts).collect()}
    dl, n = {1: 4, 2: 2, 4: 0}, 3
    tf = {("milch", 1): 3, ("milch", 2): 1, ("bio", 1): 1, ("bio", 2): 1, ("bio", 3): 1}
    df = Counter(t for t, _ in tf)
    for (t, d), f in tf.items():
        idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
        assert got["title", t, d] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl.get(d, 0) / 2)))
    assert len(got) == 6


def test_log_entropy(spark):
    rows = [(1, "title", "even", d, 2, 0) for d in range(4)] + [(1, "title", "single", 1, 3, 0), (1, "title", "bent", 0, 3, 0), (1, "title", "bent", 1, 1, 0)]
    got = {(r.token, r.doc_id): r.weight for r in weights(spark, rows, [(1, "title", d, 5) for d in range(4)]).collect()}
    assert got["even", 0] == pytest.approx(0, abs=1e-12)
    assert got["single", 1] == pytest.approx(2)
    entropy = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)) / 2
    assert got["bent", 0] == pytest.approx(2 * (1 - entropy))


def test_leading_terms(spark):
    rows = [("t", 1, "a", 4.0), ("t", 1, "b", 2.0), ("t", 1, "c", 1.0), ("t", 2, "a", 3.0), ("t", 3, "a", 3.0), ("t", 3, "b", 1.6), ("t", 4, "b", 1.0), ("t", 4, "a", 1.0)]
    df = spark.createDataFrame(rows, "field string, doc_id bigint, token string, weight double")
    assert [(r.doc_id, r.token) for r in leading_terms(df).collect()] == [(1, "a")]


def test_empty_tables(spark):
    for scheme in ("bm25", "log_entropy"):
        assert weights(spark, [], [], scheme).count() == 0
        assert weights(spark, PROWS, [], scheme).count() == 6
    with pytest.raises(ValueError):
        weights(spark, [], [], "other")
