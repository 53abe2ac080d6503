from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.analyze import WHITE_SPACE, clean_term, keyword, tokens, trigrams
from lodestone.mapping import valid_name


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_tokens(spark):
    texts = ["Bio-Milch 3,5%", "Müller", "", " -- ", None, "K İ ABC", "a_b"]
    assert column(spark, texts, tokens) == [
        ["bio", "milch", "3", "5"], ["m", "ller"], [], [], None, ["abc"], ["a", "b"],
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=1, max_size=40))
def test_tokens_of_any_text(spark, texts):
    expected = [[t.lower() for t in re.findall("[A-Za-z0-9]+", x)] for x in texts]
    assert column(spark, texts, tokens) == expected


def test_keyword_is_one_token_and_not_trimmed(spark):
    assert column(spark, [" Obst & Gemüse ", ""], keyword) == [[" obst & gemüse "], [""]]


def test_trigrams(spark):
    assert column(spark, ["milch", "abc", "ab", "", "äöüß", None], trigrams) == [
        ["mil", "ilc", "lch"], ["abc"], [], [], ["äöü", "öüß"], [],
    ]


def test_clean_term(spark):
    words = [" Milch\t", "  BIO\r\n", " 　 ", "", None, "a b"]
    assert column(spark, words, clean_term) == ["milch", "bio", None, None, None, "a b"]
    assert WHITE_SPACE.strip() == "" and all(not c.isspace() or c in WHITE_SPACE for c in map(chr, range(0x3100)))


@pytest.mark.parametrize("name,good", [("a", True), ("a-b_C9", True), ("ä字", True), ("_", True), ("", False), ("a b", False), ("!!!invalid", False), ("a/b", False), (None, False)])
def test_names(name, good):
    assert valid_name(name) is good
