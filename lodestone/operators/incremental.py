"""What a run has to process: documents added or changed since they were last processed with success.

The log of accepted documents is a :class:`~lodestone.sources.versions.VersionedTable` over the files it already
consists of.  In the version that was processed, deletion vectors hide the rows outside the windows of successful runs;
in the current version none is hidden.  A run takes the difference of the two manifests - files added, files removed and
rows by which the vectors differ - and nothing else of the log, compares it with the states in the output of the runs
before it, and writes documents whose state moved, together with the version that is now processed, in one commit.
What a run is told to process does not depend on how earlier runs ended, only on which windows ended well.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.documents import whole_object
from lodestone.sources.versions import CHANGE, VersionedTable, process_changes

SUCCESS = "ok"
#: Up to this many pieces of windows are broadcast; more are joined by day.
PIECES = 100_000
#: Parts into which the rows of a day are spread where windows are joined by day.
SPREAD = 64
_DAY = 86_400_000_000


def processed_windows(runs: DataFrame) -> DataFrame:
    """``(day, since, until)``: the time that successful runs cover, as disjoint pieces that end with the day at the latest.
    All three count from 1970 in UTC, days and microseconds.

    States are compared in any case and without spaces around; runs without a state or with an open, empty or reversed
    window cover nothing.  Windows are cut at the ends of days first, so that each day is merged by itself.
    """
    begin, end = F.unix_micros(F.col("window_from").cast("timestamp")), F.unix_micros(F.col("window_to").cast("timestamp"))
    good = runs.where(F.lower(F.btrim("state")) == SUCCESS).select(begin.alias("w0"), end.alias("w1")).where("w0 < w1")
    days = F.sequence(F.expr(f"CAST(floor(w0 / {_DAY}) AS BIGINT)"), F.expr(f"CAST(floor((w1 - 1) / {_DAY}) AS BIGINT)"))
    cut = good.select("w0", "w1", F.explode(days).alias("day")).select(
        "day", F.greatest("w0", F.col("day") * _DAY).alias("w0"), F.least("w1", (F.col("day") + 1) * _DAY).alias("w1")
    )
    in_order = Window.partitionBy("day").orderBy("w0", "w1")
    reached = F.max("w1").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("w0") > reached).cast("int"), F.lit(1))
    islands = cut.withColumn("begins", begins).withColumn("island", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("day", "island").agg(F.min("w0").alias("since"), F.max("w1").alias("until")).drop("island")


def unprocessed_rows(rows: DataFrame, runs: DataFrame, pieces: int = PIECES) -> DataFrame:
    """The rows of ``rows(landed_at, ...)`` in no window of a successful run; a row without ``landed_at`` is in none."""
    windows = processed_windows(runs)
    landed = F.unix_micros(F.col("landed_at").cast("timestamp"))
    timed = rows.withColumn("_landed", landed).withColumn("_day", F.expr(f"CAST(floor(_landed / {_DAY}) AS BIGINT)"))
    few = windows.limit(pieces + 1).collect()
    if len(few) <= pieces:
        by_day = defaultdict(list)
        for r in few:
            by_day[r["day"]].append((r["since"], r["until"]))
        kind = "_day bigint, _windows array<struct<since: bigint, until: bigint>>"
        joined = timed.join(F.broadcast(rows.sparkSession.createDataFrame(list(by_day.items()), kind)), "_day", "left")
    else:  # a day may hold most rows: it is spread over several tasks, each with the windows of that day
        listed = windows.groupBy("day").agg(F.collect_list(F.struct("since", "until")).alias("_windows"))
        copies = listed.select(F.col("day").alias("_day"), "_windows", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
        timed = timed.withColumn("_part", F.pmod(F.xxhash64("_landed"), F.lit(SPREAD)).cast("int"))
        joined = timed.join(copies, ["_day", "_part"], "left").drop("_part")
    inside = F.exists("_windows", lambda w: (w["since"] <= F.col("_landed")) & (F.col("_landed") < w["until"]))
    return joined.where(~F.coalesce(inside, F.lit(False))).drop("_day", "_landed", "_windows")


def content(parsed: Column) -> list[Column]:
    """The values that make two states of a document equal; numbers by value, however they are written."""

    def text(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "string")

    price = F.try_variant_get(parsed, "$.price", "double")
    return [text("title"), text("category"), text("organic"), price + F.lit(0.0), F.when(price.isNull(), text("price"))]


def newest_states(rows: DataFrame) -> DataFrame:
    """``(doc_id, state)`` of ``rows(doc_id, log_pos, body, written_at)``: of each document's complete rows the one with the
    greatest ``written_at``, then ``log_pos``.

    A state is when and where it was written, and a digest of its content in 128 bits, so that rows are narrow where they
    are sorted and exchanged.  Each document's rows are combined before the exchange: one may hold any share.
    """
    whole = rows.where("doc_id IS NOT NULL").select("doc_id", "log_pos", "written_at", whole_object(F.col("body")).alias("parsed"))
    values = [F.col(f"c{i}") for i in range(5)]
    read = whole.where("parsed IS NOT NULL").select(
        "doc_id", "log_pos", "written_at", *(c.alias(f"c{i}") for i, c in enumerate(content(F.col("parsed"))))
    )
    told = [x for v in values for x in (v, v.isNull())]  # a hash passes over nulls
    digests = [F.xxhash64(F.lit(salt), *told).alias(f"d{salt}") for salt in (1, 2)]
    state = F.struct("written_at", "log_pos", "d1", "d2")
    return read.select("doc_id", "written_at", "log_pos", *digests).groupBy("doc_id").agg(F.max(state).alias("state"))


def state_changes(changes: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents whose newest state is not in ``taken(doc_id, state, change)``, the output of earlier runs, with that state
    and ``change``: ``added``, ``changed``, or null if the content is what it was.

    ``changes`` are those of the log.  Rows that were removed say nothing: a log forgets only what was processed, and rows
    that merely moved to other files lead to the same states.
    """
    after = newest_states(changes.where(F.col(CHANGE) == "added"))
    before = taken.groupBy("doc_id").agg(F.max("state").alias("before"))
    moved = after.join(before, "doc_id", "left").where("before IS NULL OR state > before")
    other = (F.col("state.d1") != F.col("before.d1")) | (F.col("state.d2") != F.col("before.d2"))
    return moved.select("doc_id", "state", F.when(F.col("before").isNull(), "added").when(other, "changed").alias("change"))


_STATE = "struct<written_at: timestamp, log_pos: bigint, d1: bigint, d2: bigint>"


def take_changes(log: VersionedTable, taken: VersionedTable) -> int | None:
    """One run over what is new in ``log``; the version of ``taken`` that it has written, None if there was nothing."""

    def run(changes: DataFrame) -> DataFrame:
        if not taken.manifest().version:
            return state_changes(changes, taken.spark.createDataFrame([], f"doc_id bigint, state {_STATE}, change string"))
        return state_changes(changes, taken.read())

    return process_changes(log, taken, run, "log")


def documents_to_process(spark: SparkSession, log_files: str | list[str], runs: DataFrame, root: str) -> DataFrame:
    """``(doc_id, change)``: the documents of a log that were added or changed since they were last processed with success,
    as written by a run over the log's new rows.

    ``log_files`` are Parquet files or folders with ``(log_pos, doc_id, body, written_at, landed_at)``; they are referred
    to, not copied.  ``runs(window_from, window_to, state)`` say which rows were processed.  Versions, vectors and the
    run's output are kept below ``root``, a new folder that all executors share.

    Rows without a doc_id are no documents, rows without a complete body are passed over; a row without ``landed_at`` was
    never processed, one without ``written_at`` is older than all others; of rows that agree in ``written_at`` and
    ``log_pos`` the one with the greatest digest counts.  Further columns are not read.  Empty tables give no rows.
    """
    log, taken = VersionedTable(spark, f"{root}/log"), VersionedTable(spark, f"{root}/taken")
    log.register(log_files, lambda rows: unprocessed_rows(rows, runs))
    take_changes(log, taken)  # the state in which the last successful run has left things
    log.register(log_files)
    version = take_changes(log, taken)
    return taken.changes(version - 1, version).where("change IS NOT NULL").select("doc_id", "change")
