from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.errors import FileError, ValidationError
from lodestone.operators import incremental
from lodestone.operators.incremental import processed_windows, take_changes, unprocessed_rows
from lodestone.sources.versions import CHANGE, VersionedTable, net_changes, process_changes

T0 = datetime(2024, 5, 1)
LOG = "log_pos bigint, doc_id bigint, body string, written_at timestamp, landed_at timestamp"
RUNS = "run_id bigint, window_from timestamp, window_to timestamp, state string"


def at(days):
    return None if days is None else T0 + timedelta(days=days)


def log(spark, rows):
    return spark.createDataFrame([(p, d, b, at(w), at(a)) for p, d, b, w, a in rows], LOG)


def runs(spark, rows):
    return spark.createDataFrame([(i, at(a), at(b), s) for i, (a, b, s) in enumerate(rows)], RUNS)


def documents_to_process(tmp_path, log_rows, done):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    log_rows.write.parquet(f"{folder}/a b/log")
    return incremental.documents_to_process(log_rows.sparkSession, f"file://{folder}/a b/log", done, f"file://{folder}/root")


def body(title="x", price="1.5"):
    return f'{{"title":"{title}","category":"c","organic":true,"price":{price}}}'


def test_cases(spark, tmp_path):
    rows = [
        (1, 1, body(), 0, 0.5),  # processed
        (2, 1, body(price="15e-1"), 1, 9),  # the same content in another form
        (3, 2, body(), 0, 0.5), (4, 2, body("new"), 1, 9),  # changed
        (5, 3, body(), 1, 9),  # added
        (6, 4, body(), 5, 0.5), (7, 4, body("late"), 1, 9),  # a late row that is older than the state
        (8, 5, body()[:-3], 0, 9), (9, 5, None, 0, 9), (10, 5, "[1]", 0, 9), (11, 5, body() + " x", 0, 9), (12, 5, "", 0, 9),  # torn
        (13, 6, body(), 0, 1.5),  # in a failed window
        (14, 7, body(), 0, 2.0),  # at the end of a window, which is open
        (15, 8, body(), 0, 2.5),  # in a window of a run whose state is written otherwise
        (16, None, body(), 0, 9), (17, 9, body(), 0, None), (18, 10, body("a"), None, 0.5), (19, 10, body("b"), 0, 9),
        (20, 11, body("a"), 0, 0.5), (21, 11, body("b"), 0, 9),  # of two at one time the later in the log
        (22, 12, '{"price":1}', 0, 0.5), (23, 12, '{"price":1.0,"title":null}', 1, 9),  # absent and null are one value
    ]
    done = runs(spark, [(0, 1, "ok"), (1, 2, "failed"), (2.25, 3, " OK "), (0.25, 0.75, "Ok"), (5, 4, "ok"), (None, 20, "ok"), (0, 20, None)])
    got = {r.doc_id: r.change for r in documents_to_process(tmp_path, log(spark, rows), done).collect()}
    assert got == {2: "changed", 3: "added", 6: "added", 7: "added", 9: "added", 10: "changed", 11: "changed"}


@pytest.mark.parametrize("pieces", [100_000, 0])
def test_windows(spark, pieces):
    chooser = random.Random(2)
    windows = [(a := chooser.uniform(0, 9), a + chooser.choice([0.01, 0.3, 2.5]), "ok") for _ in range(12)] + [(3, 4, "ok"), (4, 5, "OK"), (5, 9, "failed")]
    done = runs(spark, windows)
    pieces_found = processed_windows(done).collect()
    assert len({(r.day, r.since) for r in pieces_found}) == len(pieces_found)
    for x, y in zip(ordered := sorted((r.since, r.until) for r in pieces_found), ordered[1:]):
        assert x[1] <= y[0]
    times = [i / 40 for i in range(480)] + [3.0, 5.0, None]
    rows = spark.createDataFrame([(i, at(t)) for i, t in enumerate(times)], "i int, landed_at timestamp")
    covered = {i for i, t in enumerate(times) if t is not None and any(s.lower() == "ok" and at(a) <= at(t) < at(b) for a, b, s in windows)}
    assert {r.i for r in unprocessed_rows(rows, done, pieces).collect()} == set(range(len(times))) - covered


def test_empty_tables_and_no_runs(spark, tmp_path):
    nothing, one = log(spark, []), log(spark, [(1, 1, body(), 0, 0)]).withColumn("state", F.lit(1)).withColumn("_row", F.lit(5))
    assert documents_to_process(tmp_path, nothing, runs(spark, [])).count() == 0
    assert [r.change for r in documents_to_process(tmp_path, one.drop("_row"), runs(spark, [])).collect()] == ["added"]
    assert documents_to_process(tmp_path, one.drop("_row"), runs(spark, [(0, 1, "ok")])).count() == 0


def test_only_changed_files_and_rows_are_read(spark, tmp_path):
    """A file that no run has touched is added as a whole; of one that was processed in part the vector's rows are."""
    for name, days in (("old", [0, 0.5]), ("mixed", [0, 3]), ("new", [3, 3.5])):
        log(spark, [(i, hash((name, i)) % 10**6, body(), 0, d) for i, d in enumerate(days)]).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    paths = [f"file://{tmp_path}/{n}" for n in ("old", "mixed", "new")]
    done = runs(spark, [(0, 1, "ok")])
    table.register(paths, lambda rows: unprocessed_rows(rows, done))
    table.register(paths)
    a, b = table.manifest(1), table.manifest(2)
    assert (len(a.files), len(b.files)) == (2, 3) and sum(v is not None for v in a.files.values()) == 1 and set(b.files.values()) == {None}
    changed = table.changes(1, 2)
    assert changed.count() == 3 and table.read(1).count() == 3 and {r[CHANGE] for r in changed.collect()} == {"added"}
    assert "old" not in " ".join(changed.inputFiles())


@pytest.mark.parametrize("words", [100_000, 0])
def test_vectors_joined_either_way(spark, tmp_path, words):
    table = VersionedTable(spark, f"file://{tmp_path}/t", words)
    table.append(spark.range(1_000).repartition(3))
    table.delete(F.col("id") % 7 == 0)
    table.append(spark.range(1_000, 1_200))
    table.delete((F.col("id") % 5 == 0) & (F.col("id") > 900))
    gone = {i for i in range(1_200) if (i % 7 == 0 and i < 1_000) or (i % 5 == 0 and i > 900)}
    assert {r.id for r in table.read().collect()} == set(range(1_200)) - gone
    assert {r.id for r in table.changes(2, 4).where("_change = 'removed'").collect()} == {i for i in gone if i % 5 == 0 and 900 < i < 1_000 and i % 7}


def test_a_run_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    log_rows = log(spark, [(1, 1, body("a"), 0, 0.5), (2, 2, body("b"), 0, 9), (3, 1, body("c"), 1, 9)])
    log_rows.write.parquet(f"{folder}/log_files")
    table, taken = VersionedTable(spark, f"{folder}/log"), VersionedTable(spark, f"{folder}/taken")
    table.register(f"{folder}/log_files", lambda rows: unprocessed_rows(rows, runs(spark, [(0, 1, "ok")])))
    assert take_changes(table, taken) == 1
    table.register(f"{folder}/log_files")

    def dies(*a, **k):
        raise RuntimeError("killed")

    monkeypatch.setattr(taken, "_commit", dies)  # its files are written, its manifest is not
    with pytest.raises(RuntimeError):
        take_changes(table, taken)
    monkeypatch.undo()
    assert taken.manifest().processed == {"log": 1} and taken.read().count() == 1
    again = VersionedTable(spark, taken.root)
    assert take_changes(table, again) == 2 and again.manifest().processed == {"log": 2}
    assert {(r.doc_id, r.change) for r in again.changes(1, 2).collect()} == {(1, "changed"), (2, "added")}
    assert take_changes(table, again) is None
    table.append(log(spark, [(4, 1, body("c"), 2, 10), (5, 2, body("x"), -1, 10), (6, 3, body(), 0, 10)]))
    assert take_changes(table, again) == 3
    assert {(r.doc_id, r.change) for r in again.changes(2, 3).collect()} == {(1, None), (3, "added")}
    table.compact()
    assert take_changes(table, again) == 4 and again.changes(3, 4).count() == 0


def test_other_fields(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.append(spark.range(2).withColumn("v", F.lit(1)))
    table.append(spark.range(2, 4).withColumn("v", F.lit(2)).withColumn("extra", F.lit("x")))
    table.append(spark.range(4, 5))
    assert sorted(tuple(r) for r in table.read().collect()) == [(0, 1, None), (1, 1, None), (2, 2, "x"), (3, 2, "x"), (4, None, None)]
    assert table.read(1).columns == ["id", "v"] and table.changes(1, 2).columns == ["id", "v", "extra", CHANGE]
    for other in (spark.range(1).withColumn("v", F.lit("text")), spark.range(1).withColumn("V", F.lit(1))):
        with pytest.raises(ValidationError):
            table.append(other)
    assert table.manifest().version == 3


def rows_of(df):
    return sorted((r["id"], r[CHANGE]) for r in df.collect())


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert table.read().count() == 0 and table.append(df.where("id < 6")) == 1
    assert table.append(df.where("id >= 6")) == 2
    assert table.delete(F.col("id").isin(2, 7)) == 3
    assert table.delete(F.col("id") == 3) == 4
    assert sorted(r["id"] for r in table.read().collect()) == [0, 1, 4, 5, 6, 8, 9]
    assert sorted(r["id"] for r in table.read(2).collect()) == list(range(10))
    assert rows_of(table.changes(0, 1)) == [(i, "added") for i in range(6)]
    assert rows_of(table.changes(2, 4)) == [(2, "removed"), (3, "removed"), (7, "removed")]
    assert rows_of(table.changes(4, 2)) == [(2, "added"), (3, "added"), (7, "added")]
    assert rows_of(table.changes(1, 3)) == [(2, "removed"), (6, "added"), (8, "added"), (9, "added")]
    table.compact()
    assert sorted(r["id"] for r in table.read().collect()) == [0, 1, 4, 5, 6, 8, 9]
    assert len(rows_of(table.changes(4, 5))) == 14 and net_changes(table.changes(4, 5)).count() == 0
    assert table.changes(5, 5).count() == 0
    with pytest.raises(FileError):
        table.read(99)


def test_progress_is_saved_with_the_output(spark, tmp_path):
    source, target = (VersionedTable(spark, f"file://{tmp_path}/{n}") for n in ("source", "target"))

    def take(changes):
        return changes.select("id", F.col(CHANGE).alias("change"))

    source.append(spark.range(3).select("id"))
    assert process_changes(source, target, take) == 1 and process_changes(source, target, take) is None
    source.append(spark.range(3, 5).select("id"))

    def broken(changes):
        return changes.select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"), F.col(CHANGE).alias("change"))

    with pytest.raises(Exception, match="lost"):
        process_changes(source, target, broken)
    assert target.manifest().processed == {"source": 1} and target.read().count() == 3
    slow = VersionedTable(spark, target.root)
    stale = slow.manifest()
    slow.manifest = lambda version=None: stale  # a run that began before the next one committed
    assert process_changes(source, target, take) == 2
    with pytest.raises(FileError):
        process_changes(source, slow, take)
    assert sorted(r["id"] for r in target.read().collect()) == [0, 1, 2, 3, 4]
