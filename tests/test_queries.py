"""Every registered query of the core beside its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from compare import rows_of
from lodestone.plans.oracle import SQL
from lodestone.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def test_sql_belongs_to_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in SQL:
        cursor = db.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(names, cursor.fetchall())
    elif name != "search_result_json":
        assert rows


def test_anchors_of_many_segments_have_one_plan(spark, tmp_path):
    """Segments grow with the table: the plan of their anchors must not."""
    rows = [(s, f, f"w{n * 7 % 211:03}", d) for s in (*range(120), None) for n in range(s % 3 * 60 + 9 if s else 300) for f in ("t", "k", None) for d in range(2)]
    rows += [(500, "t", None, 1), (None, "t", "w", 1)]
    schema = "segment_id int, field string, token string, doc_id bigint"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/postings.parquet")
    found = QUERIES["layout_anchors"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("WindowGroupLimit") == 2 and "Union" not in plan
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW postings AS SELECT * FROM '{tmp_path}/postings.parquet/*.parquet'")
        cursor = db.execute(SQL["layout_anchors"])
        names = [d[0] for d in cursor.description]
        expected = cursor.fetchall()
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(names, expected)
    assert found.where("field IS NULL").count() > 0 and found.where("block = 9").count() > 0
