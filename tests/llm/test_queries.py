"""The registered queries for training data beside their SQL, or beside brute force where there is none."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import rows_of
from lodestone.llm.queries import QUERIES
from lodestone.llm.sql import SQL
from lodestone.llm.tokenizing import VOCABULARY, load
from tests.llm.test_repetition import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


def test_ids(spark, texts):
    got = QUERIES["p6_ids"](spark, FOLDER).collect()
    assert {r.doc_id: r.ids for r in got} == {i: load(VOCABULARY).encode(t or "").tolist() for i, t in texts.items()}
    assert len(got) == len(texts)


def test_containers(spark, texts):
    got = QUERIES["p7_containers"](spark, FOLDER).collect()
    size, fill = Counter(), Counter()
    for r in got:
        size[r.doc_id] += r.n_tokens
        fill[r.container_id] += r.n_tokens
    assert size == {i: len(load(VOCABULARY).encode(t or "")) for i, t in texts.items()}
    assert max(fill.values()) <= 2_048
    assert all(r.part == 0 for r in got if size[r.doc_id] <= 2_048)


def test_repetition(spark, texts):
    expected = set()
    for i, t in texts.items():
        letters, again = brute(t or "", 20)
        if again and again * 10 >= letters * 3:
            expected.add(i)
    assert {r.doc_id for r in QUERIES["p8_found"](spark, FOLDER).collect()} == expected
