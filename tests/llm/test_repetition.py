from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import repetition as r


def brute(text, n):
    letters = [c for c in text.lower() if unicodedata.category(c)[0] == "L"]
    seen, marked = set(), set()
    for i in range(len(letters) - n + 1):
        gram = tuple(letters[i : i + n])
        if gram in seen:
            marked.update(range(i, i + n))
        seen.add(gram)
    return len(letters), len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text("abAB ß1İ漢", max_size=80), st.integers(1, 9), st.sampled_from([3, 10, 1 << 22]))
def test_against_brute_force(text, n, windows):
    letters, (again,) = r.measure(text, (n,), windows)
    assert (letters, again) == brute(text, n)


@pytest.mark.parametrize("n", [1, 2, 3, 20, 50])
def test_long_text_in_several_passes(n):
    chooser = random.Random(n)
    text = "".join(chooser.choice(["lorem ipsum ", "dolor sit amet. ", "X", "é"]) for _ in range(2_000))
    for windows in (1_000, 1 << 22):
        assert r.measure(text, (n,), windows)[1][0] == brute(text, n)[1]


def test_colliding_hashes_are_told_apart(monkeypatch):
    hashes = r.window_hashes
    monkeypatch.setattr(r, "window_hashes", lambda codes, n: hashes(codes, n) % 3)
    text = "abcabdabcxyzabdqabc" * 3
    for n in (2, 3, 5):
        assert r.measure(text, (n,))[1][0] == brute(text, n)[1]


def test_lines():
    assert r.repeated_lines("a b\n\n a b \nc\n") == (7, 3)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, " 12 "), (None, "abc" * 30), (4, "abc" * 30), (4, "abc" * 30), (5, "line\nline\nx")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id bigint, text string, n_letters double")
    got = sorted(r.repetition(df, ngram_lengths=(3, 20)).collect(), key=repr)
    assert [(x.doc_id, x.n_letters, x.repeated_3, x.repeated_20) for x in got] == sorted(
        [(i, *brute(t or "", 3), brute(t or "", 20)[1]) for i, t in rows], key=lambda x: repr(x).replace("(", "Row(doc_id=")
    )
    assert max(x.share_lines for x in got) == pytest.approx(4 / 9)
    assert r.repetition(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        r.repetition(df, ngram_lengths=())
