from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.mapping import Mapping
from lodestone.operators import index as ix
from lodestone.operators import search as se

MAPPING = Mapping.of([("t", "Text", False), ("k", "Keyword", False), ("n", "Number", False)])
SCHEMA = "doc_id long, doc struct<t:string,k:string,n:double>"


def tokenize(text):
    return [t.lower() for t in re.findall("[A-Za-z0-9]+", text)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grams(t):
    return [t[i : i + 3] for i in range(len(t) - 2)]


def model(docs, queries, mode):
    """An independent rendering of the ranking, for few documents; mode: None (exact), first or full."""
    cells = {}
    for d, (t, k, _) in docs:
        if t is not None:
            cells[d, "t"] = tokenize(t)
        if k is not None:
            cells[d, "k"] = [k.lower()]
    known = {}
    for f in ("k", "t"):
        own = defaultdict(list)
        for (d, g), toks in sorted(cells.items()):
            if g == f:
                for tok in toks:
                    for gram in grams(tok):
                        if tok not in own[gram] and (mode == "full" or not own[gram]):
                            own[gram].append(tok)
        for gram, toks in own.items():
            if mode == "full":
                known.setdefault(gram, []).extend(toks)
            else:
                known.setdefault(gram, toks)
    out = {}
    for q, text in queries:
        total = Counter()
        terms = []
        for tok in tokenize(text):
            near = {c for gram in grams(tok) for c in known.get(gram, []) if edits(tok, c) <= 1} if mode else set()
            terms.append(sorted(near | {tok}))
        for f in ("k", "t"):
            own = {d: toks for (d, g), toks in cells.items() if g == f}
            n = len(own)
            if not n or not terms:
                continue
            avgdl = sum(map(len, own.values())) / n or 1.0
            sums, count = Counter(), Counter()
            for alternatives in terms:
                tf = {}
                for d, toks in own.items():
                    hit = [a for a in alternatives if a in toks]
                    if hit:
                        tf[d] = toks.count(hit[0])
                for d, x in tf.items():
                    idf = math.log((n - len(tf) + 0.5) / (len(tf) + 0.5) + 1)
                    sums[d] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(own[d]) / avgdl))
                    count[d] += 1
            for d in sums:
                if count[d] == len(terms):
                    total[d] += sums[d]
        ranked = sorted(((round(s, 6), d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))
        out[q] = [(d, pytest.approx(s, abs=2e-6)) for s, d in ranked]
    return out


def run(spark, docs, queries, mode, parts=1):
    built = None
    for k in range(parts):
        part = ix.build(spark.createDataFrame(docs[k::parts], SCHEMA), MAPPING)
        built = part if built is None else built.union(part)
    rows = se.search_batch(spark.createDataFrame(queries, "query_id int, q string"), built, bool(mode), mode or "first").collect()
    got = {q: [] for q, _ in queries}
    for r in sorted(rows, key=lambda r: (r.query_id, r.place)):
        got[r.query_id].append((r.doc_id, r.score))
    return got


WORDS = ["milch", "milk", "mlich", "bio", "ring", "rong", "3", "käse", "Red", "reed", "a"]
TEXT = st.one_of(st.none(), st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join))
DOC = st.tuples(TEXT, st.one_of(st.none(), st.sampled_from(["Red", "obst & gemüse", "milch"])), st.none())


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DOC, min_size=1, max_size=12), st.lists(st.sampled_from(WORDS + ["zzz", "mil ch"]), max_size=3).map(" ".join))
def test_against_the_model(spark, docs, q):
    numbered = [(i + 1, d) for i, d in enumerate(docs)]
    queries = [(0, q), (1, "milch"), (2, "red red")]
    for mode in (None, "first", "full"):
        for parts in (1, 2):
            got, expected = run(spark, numbered, queries, mode, parts), model(numbered, queries, mode)
            assert {k: len(v) for k, v in got.items()} == {k: len(expected.get(k, [])) for k in got}
            assert all({d: s for d, s in got[k]} == {d: s for d, s in expected.get(k, [])} for k in got)


def test_first_token_of_a_trigram_hides_later_ones(spark):
    docs = [(1, ("milch", None, None)), (2, ("milk", None, None))]
    queries = [(0, "milx"), (1, "milkk"), (2, "rong")]
    assert {q: [d for d, _ in v] for q, v in run(spark, docs, queries, "first").items()} == {0: [], 1: [2], 2: []}
    assert {q: [d for d, _ in v] for q, v in run(spark, docs, queries, "full").items()} == {0: [2], 1: [2], 2: []}


def test_cut_after_ties(spark):
    docs = [(i, ("same", None, None)) for i in range(150, 0, -1)]
    assert [d for d, _ in run(spark, docs, [(0, "same")], None)[0]] == list(range(1, 101))


def test_empty_index_and_no_indexed_field(spark):
    assert run(spark, [], [(0, "x")], None) == {0: []}
    only_numbers = Mapping.of([("n", "Number")])
    df = spark.createDataFrame([(1, (1.0,))], "doc_id long, doc struct<n:double>")
    built = ix.build(df, only_numbers)
    assert built.postings.count() == 0 and built.docs.count() == 1


def test_fields_and_modes(spark):
    docs = [(1, ("red", "blue", None)), (2, ("blue", "red", None)), (3, ("red blue", None, None))]
    built = ix.build(spark.createDataFrame(docs, SCHEMA), MAPPING)
    asked = spark.createDataFrame([(0, "red blue")], "query_id int, q string")
    assert [r.doc_id for r in se.search_batch(asked, built).collect()] == [3]
    assert {r.doc_id for r in se.search_batch(asked, built, mode="or").collect()} == {1, 2, 3}
    assert {r.doc_id for r in se.search_batch(asked, built, mode="or", fields=["k"]).collect()} == {1, 2}
    with pytest.raises(ValueError):
        se.alternatives(se.query_terms(asked), built, "some")


def test_numbering(spark):
    rows = spark.range(1_000).selectExpr("id % 97 AS a", "id")
    got = ix.number_documents(rows, 10, ["a", "id"]).orderBy("a", "id").collect()
    assert [r.doc_id for r in got] == list(range(11, 1_011))
    assert ix.number_documents(rows.limit(0), 10, ["a"]).count() == 0


@pytest.mark.parametrize("fuzzy", [False, True])
def test_terms_that_are_too_many_to_broadcast(spark, fuzzy):
    """Joined by exchange, with a token that most documents have."""
    docs = spark.createDataFrame([(i, (f"common word{i % 5}", None, None)) for i in range(300)], SCHEMA)
    index = ix.build(docs, MAPPING)
    queries = spark.createDataFrame([(1, "common"), (2, "common word3"), (3, "wrod3"), (4, "")], "query_id int, q string")
    few, many = (se.search_batch(queries, index, fuzzy, "full", local_terms=n).collect() for n in (1_000, 0))
    assert sorted(few) == sorted(many) and len(few) >= 160
    assert se.literal_terms(spark, [(1, "Common WORD3-x"), (2, "")]).collect() == se.query_terms(spark.createDataFrame([(1, "Common WORD3-x"), (2, "")], "query_id int, q string")).collect()
