from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.tokenizing import VOCABULARY, encode_corpus, load

BPE = load(VOCABULARY)
PARTS = ["'s", "'re", "'", " ", "  ", "\n\n", "\t", "a", "the", " the", "Straße", "漢字", "😀", "é", "123", "!!", "...", " ", "<|endoftext|>", "ق", "aaaa", "_", "'ll'd"]


def pieces_of(text, n):
    return [text[i : i + n] for i in range(0, len(text), n)] or [""]


def by_tree(text, n):
    return BPE.concatenate([BPE.encode(x) for x in pieces_of(text, n)]).tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(1, 40))
def test_joined_pieces_equal_the_whole(text, n):
    assert by_tree(text, n) == BPE.encode(text).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 50))
def test_joined_pieces_of_any_text(text, n):
    assert by_tree(text, n) == BPE.encode(text).tolist()


@pytest.mark.parametrize("alphabet", ["ab", "a", " ", " \n", "abcdefghij", "漢字仮名", "😀", "'s", "-=", "0123456789"])
def test_long_runs_without_a_split(alphabet):
    chooser = random.Random(alphabet)
    text = "".join(chooser.choice(alphabet) for _ in range(5_000))
    for n in (7, 100, 1_024):
        assert by_tree(text, n) == BPE.encode(text).tolist()


def test_long_text_does_not_take_square_time():
    text = "x" * 400_000
    assert by_tree(text, 4_096) == BPE.encode(text).tolist()


def test_corpus(spark):
    texts = ["", None, " ", "plain <|endoftext|> text", "word " * 50, "漢" * 333, "a'" * 200, "x" * 1_000]
    rows = [(i, t, "other") for i, t in enumerate(texts)] + [(None, "no id " * 20, "x"), (7, "x" * 1_000, "again"), (7, "other " * 40, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    expected = sorted(((i, BPE.encode(t or "").tolist()) for i, t, _ in rows), key=repr)
    for piece_chars in (16, 64, 16_384):
        got = encode_corpus(df, piece_chars=piece_chars)
        assert got.columns == ["doc_id", "ids"]
        assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == expected
        counts = encode_corpus(df, piece_chars=piece_chars, counts_only=True).collect()
        assert sorted((r.n_tokens for r in counts)) == sorted(len(x) for _, x in expected)


def test_empty_corpus(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ids_decode_to_the_text():
    text = "Ünïcödé — 'twas 3,5 % of   it\n\n"
    assert BPE.text_of(np.asarray(BPE.encode(text))) == text
