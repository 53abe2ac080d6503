from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.errors import ParseError, ValidationError
from lodestone.mapping import TYPES, Mapping
from lodestone.operators.documents import Undecided, parse_document, parse_documents, result_json, typed_documents

NAMES = st.text("abcXYZ019-_ä", min_size=1, max_size=30)
FIELDS = st.lists(st.tuples(NAMES, st.sampled_from(list(TYPES)), st.booleans()), min_size=1, max_size=10, unique_by=lambda f: f[0])


@settings(max_examples=100, deadline=None)
@given(FIELDS)
def test_json_form(fields):
    mapping = Mapping.of(fields)
    mapping.validate("new", ["other"])
    assert Mapping.of(mapping.to_json()) == mapping
    assert [f.name for f in mapping.schema().fields] == [f[0] for f in fields]


@pytest.mark.parametrize("value", ['{"fields": []}', "{}", "[", "[]", {"fields": [{"fieldName": "a b", "sType": "Text"}]}, {"fields": [{"fieldName": "a", "sType": "Date"}]}, {"fields": [{"fieldName": "a", "sType": "Text", "required": 1}]}, {"fields": [1]}])
def test_refused(value):
    with pytest.raises(ParseError):
        Mapping.of(value)


def test_required_by_default():
    wire = '{"fields":[{"fieldName":"title","sType":"Text"},{"fieldName":"o","sType":"Text","required":false}]}'
    assert [f.required for f in Mapping.of(wire).fields] == [True, False]


def test_all_problems_are_told():
    with pytest.raises(ValidationError, match="^fields declared more than once: a, b - there is an index i already$"):
        Mapping.of([("b", "Text"), ("a", "Text"), ("a", "Bool"), ("b", "Text")]).validate("i", ["i"])


def test_added_field_comes_first_and_is_checked():
    mapping = Mapping.of([("a", "Text")]).with_field(("b", "Bool", False))
    assert [f.name for f in mapping.fields] == ["b", "a"]
    with pytest.raises(ValidationError):
        mapping.with_field({"fieldName": "a", "sType": "Text"})


MAPPING = Mapping.of([("t", "Text"), ("k", "Keyword", False), ("b", "Bool", False), ("n-ä", "Number", False)])


def parsed(spark, texts, mapping=MAPPING):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    return {r.i: (r.doc.asDict() if r.doc else None, r.error) for r in parse_documents(rows, mapping, keep=("i",)).collect()}


def test_documents_are_checked_and_not_coerced(spark):
    good = ['{"t":"x","k":"K","b":true,"n-ä":1.5,"other":[1]}', '{"t":"","k":null}', ' {"t":"\\u00fc","n-ä":3} ', '{"t":"x","n-ä":12345678901234567890123}']
    bad = ['{"k":"K"}', '{"t":null}', '{"t":5}', '{"t":"x","k":5}', '{"t":"x","b":"true"}', '{"t":"x","n-ä":"1"}', '{"t":["x"]}', "[]", '"t"', "", None, '{"t":"x"', '{"t":"x"} y', '{"t":"x"},{"t":"y"}', '{"t":"x","b":1}']
    got = parsed(spark, good + bad)
    assert got[0][0] == {"t": "x", "k": "K", "b": True, "n-ä": 1.5}
    assert got[1][0] == {"t": "", "k": None, "b": None, "n-ä": None}
    assert got[2][0]["t"] == "ü" and got[2][0]["n-ä"] == 3.0
    assert got[3][0]["n-ä"] == pytest.approx(1.2345678901234568e22)
    assert all(got[i][1] is None for i in range(len(good)))
    assert all(got[len(good) + i][0] is None and got[len(good) + i][1] for i in range(len(bad)))
    assert "not found" in got[len(good)][1] and "not found" in got[len(good) + 1][1]


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, None, 3)], "id int, t string, n int")
    mapping = Mapping.of([("t", "Text"), ("n", "Number"), ("k", "Keyword", False)])
    rows = {r.doc_id: r for r in typed_documents(df, mapping, "id").collect()}
    assert rows[1].doc.asDict() == {"t": "x", "n": 2.0, "k": None} and "not found" in rows[2].error
    with pytest.raises(ValueError):
        typed_documents(df.drop("t"), mapping)


def test_result_json_leaves_out_absent_fields(spark):
    df = spark.createDataFrame([(1, 0.5, ("x", None))], "id long, score double, doc struct<t:string,k:string>")
    assert json.loads(result_json(df).collect()[0].json) == {"id": 1, "score": 0.5, "doc": {"t": "x"}}


TEXTS = [
    '{"t":"a","n":1}', '{"t":"a","n":1.5,"b":true,"x":[1,{"y":2}]}', '{"t":null,"n":1}', '{"n":1}', '{"t":1,"n":1}', '{"t":"a","n":"1"}', '{"t":"a","n":true}',
    '{"t":"a","n":1,"b":"true"}', '{"t":"a","n":1,"b":null}', '', ' ', '[]', '[{"t":"a","n":1}]', '1', 'null', '{"t":"a","n":1} x', '{"t":"a","n":1}{}', '{"t":"a","n":1},',
    '\n\t {"t":"a","n":1}\r\n ', '{"t":"a","t":"b","n":1}', '{"t":"a","n":01}', '{"t":"a","n":NaN}', "{'t':'a','n':1}", '{"t":"a","n":1,}', '{"t":"ä\u00a0€😀","n":-0.0}',
    '{"t":"a","n":12345678901234567890123}', '{"t":"a","n":1e5}', '{"t":"a","n":1E-7}', '{"t":"tab\tinside","n":1}', '{"T":"a","n":1}', '{"t":"","n":0}', '{t:"a","n":1}', '{"t":"a","n":+1}',
    '{"t":"a","n":.5}', '{"t":"a","n":5.}', '{"t":"a" "n":1}', '{"t":"a","n":1', '{"t":{"z":1},"n":1}', '{"t":"a","n":[1]}', '{"t":"a\\nb","n":1}', '{"t":"a","n":1,"x":{"d":1,"d":2}}',
]


def test_the_driver_checks_like_the_executors(spark):
    mapping = Mapping.of([("t", "Text"), ("n", "Number"), ("b", "Bool", False)])
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, json string")
    got = {r.i: (r.doc and {k: v for k, v in r.doc.asDict().items() if v is not None}, r.error) for r in parse_documents(rows, mapping, "json", ("i",)).collect()}
    assert {TEXTS[i]: got[i] for i in got} == {t: parse_document(t, mapping) for t in TEXTS}
    for t in ('{"t":"\\ud800","n":1}', '{"t":"a","n":1e400}', '{"t":"\ud800","n":1}', "[" * 100_000):
        with pytest.raises(Undecided):
            parse_document(t, mapping)
