"""Indexes on disk: a log of accepted documents, immutable segments, and a manifest that says which of them count.

Everything below an index's folder but the newest manifest can be missing from it and be swept; nothing that a manifest
names is changed.  A run that fails before its manifest is written has had no effect.
"""

from __future__ import annotations

import json
import random
import re
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.errors import FileError, SearchError
from lodestone.mapping import Mapping, valid_name
from lodestone.operators import index as ix
from lodestone.session import local_table
from lodestone.sources.files import Files

COMPACT_AT = 5
TABLES = ("docs", "postings", "field_stats", "trigrams", "grams")
#: Attempts of a commit that other runs get ahead of.
ATTEMPTS = 200


@dataclass(frozen=True)
class LogPart:
    """Accepted documents below ``log/<key>``, as ``json`` (one file of lines), ``rows`` (Parquet) or ``given`` (Parquet with
    ids of the caller's).  Documents know their place in what was written, not their ids: the id is ``first``, plus the
    number of documents in the tasks before (``starts``, by task), plus the place.  So ``first`` alone changes if another
    run has taken ids in the meantime."""

    key: str
    kind: str
    count: int
    first: int = 1
    starts: tuple[tuple[int, int], ...] = ((0, 0),)

    @property
    def path(self) -> str:
        return f"log/{self.key}"


@dataclass(frozen=True)
class State:
    """``segments`` are folders below the index; ``streams`` the last batch taken from each stream; ``lengths``
    has, for each segment and field, the number of documents and of tokens, which every ranking needs; ``sizes`` the
    documents of each segment."""

    version: int
    mapping: Mapping
    segments: tuple[str, ...] = ()
    log: tuple[LogPart, ...] = ()
    max_doc_id: int = 0
    next_segment: int = 1
    streams: dict[str, int] = field(default_factory=dict)
    lengths: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        told = {**self.__dict__, "mapping": json.loads(self.mapping.to_json()), "log": [asdict(p) for p in self.log]}
        return json.dumps({"format": 2, **told}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> State:
        d = json.loads(text)
        log = tuple(LogPart(**{**p, "starts": tuple(map(tuple, p["starts"]))}) for p in d["log"])
        return State(d["version"], Mapping.of(d["mapping"]), tuple(d["segments"]), log, d["max_doc_id"], d["next_segment"], d["streams"], d["lengths"], d["sizes"])


def to_merge(sizes: dict[str, int], new: int, compact_at: int) -> set[str]:
    """The segments that a new one of ``new`` documents is merged with.

    Sizes fall into tiers, each ``compact_at + 1`` times the one before.  If there are ``compact_at`` segments of the new
    one's tier or below, they are merged with it; the result may complete the next tier.  So a document is rewritten once
    a tier, as often as the logarithm of their number tells.
    """

    def tier(n: int) -> int:
        t = 0
        while n > compact_at:
            n, t = n // (compact_at + 1), t + 1
        return t

    merged: set[str] = set()
    while True:
        top = tier(new + sum(sizes[s] for s in merged))
        found = {s for s in sizes if s not in merged and tier(sizes[s]) <= top}
        if len(found) < compact_at:
            return merged
        merged |= found


class Store:
    """Indexes below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._opened: dict[str, tuple[int, ix.IndexTables]] = {}
        self._newest: dict[str, State] = {}
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)

    def folder(self, name: str) -> str:
        return f"{self.root}/indexes/{name}"

    def names(self) -> list[str]:
        """Indexes that have a manifest; folders whose names are no index names are passed over."""
        return [n for n in self.files.names(f"{self.root}/indexes") if valid_name(n) and self._versions(n)]

    def _versions(self, name: str) -> list[int]:
        found = self.files.names(f"{self.folder(name)}/manifests")
        return [int(n[1:-5]) for n in found if n.startswith("v") and n.endswith(".json")]

    def _manifest(self, name: str, version: int) -> str:
        return f"{self.folder(name)}/manifests/v{version:020d}.json"

    def state(self, name: str) -> State:
        known = self._newest.get(name)
        # Manifests are pruned from the oldest on: while one is there, the next is missing only if it was never written.
        if known and not self.files.exists(self._manifest(name, known.version + 1)) and self.files.exists(self._manifest(name, known.version)):
            return known
        versions = self._versions(name) if valid_name(name) else []
        if not versions:
            raise SearchError(f"no index of the name {name}")
        self._newest[name] = State.from_json(self.files.read(self._manifest(name, max(versions))))
        return self._newest[name]

    def commit(self, name: str, state: State) -> State:
        """Writes the state as the version after ``state.version``; an error if another run has written that."""
        new = replace(state, version=state.version + 1)
        path = self._manifest(name, new.version)
        done = self.files.write_new(path, new.to_json())
        # A version may be missing because it was pruned: then the one before is gone too, and this one is void.
        if done and not (self.files.exists(self._manifest(name, state.version)) if state.version else self._versions(name) == [new.version]):
            self.files.delete(path)
            done = False
        if not done:
            raise FileError(f"version {new.version} of {name} was written by another run")
        self._newest[name] = new
        return new

    def change(self, name: str, how: Callable[[State], State | None]) -> State | None:
        """Commits what ``how`` makes of the newest state, again from the then newest if another run was first; None, and
        no commit, if it gives None.  Threads of one process take turns."""
        with self._locks[name]:
            for _ in range(ATTEMPTS):
                changed = how(self.state(name))
                if changed is None:
                    return None
                try:
                    return self.commit(name, changed)
                except FileError:
                    time.sleep(random.uniform(0, 0.05))
        raise FileError(f"{name} was changed by other runs {ATTEMPTS} times in a row")

    # -- log ----------------------------------------------------------------------------------------------------------

    def append_lines(self, name: str, docs: list[dict]) -> LogPart:
        """Writes a few documents, in the order given, without a job; they count once a manifest names the part."""
        part = LogPart(uuid.uuid4().hex, "json", len(docs))
        lines = [json.dumps({"_at": i, "doc": d}, ensure_ascii=False) for i, d in enumerate(docs)]
        self.files.write(f"{self.folder(name)}/{part.path}.json", "\n".join(lines) + "\n")
        return part

    def append_log(self, name: str, docs: DataFrame) -> LogPart:
        """Writes ``docs``: with a column ``doc_id``, these are the ids; without, the documents are numbered task by task as
        they are read, which exchanges and sorts nothing."""
        key = uuid.uuid4().hex
        folder = f"{self.folder(name)}/log/{key}"
        if "doc_id" in docs.columns:
            docs.select("doc_id", "doc").write.parquet(folder)
            return LogPart(key, "given", self.spark.read.parquet(folder).count())
        docs.select(F.monotonically_increasing_id().alias("_at"), "doc").write.parquet(folder)
        tasks = self.spark.read.schema("_at bigint").parquet(folder).groupBy(F.shiftright("_at", 33).alias("task")).count().collect()
        starts, n = [], 0
        for task, count in sorted(map(tuple, tasks)):  # one number a task
            starts.append((task, n))
            n += count
        return LogPart(key, "rows", n, 1, tuple(starts))

    def _doc_schema(self, mapping: Mapping, first: str = "doc_id") -> StructType:
        fields = [StructField(f.name, f.dataType) for f in mapping.schema().fields]
        return StructType([StructField(first, LongType()), StructField("doc", StructType(fields))])

    def read_log(self, name: str, state: State) -> DataFrame:
        """``(doc_id, doc)`` of the documents that are in no segment yet."""
        base, out = self.folder(name), []
        placed = self._doc_schema(state.mapping, "_at")
        for kind in ("json", "rows"):
            parts = [p for p in state.log if p.kind == kind]
            if not parts:
                continue
            if kind == "json":
                rows = self.spark.read.schema(placed).json([f"{base}/{p.path}.json" for p in parts])
            else:
                rows = self.spark.read.schema(placed).parquet(*(f"{base}/{p.path}" for p in parts))
            starts = [(p.key, task, p.first + n) for p in parts for task, n in p.starts]
            offsets = F.broadcast(local_table(self.spark, starts, "_key string, _task bigint, _start bigint"))  # a row for each task
            key = F.regexp_extract("_metadata.file_path", "/log/([0-9a-f]{32})[./]", 1)
            rows = rows.select(key.alias("_key"), F.shiftright("_at", 33).alias("_task"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place"), "doc")
            out.append(rows.join(offsets, ["_key", "_task"]).select((F.col("_start") + F.col("_place")).alias("doc_id"), "doc"))
        given = [f"{base}/{p.path}" for p in state.log if p.kind == "given"]
        if given:
            out.append(self.spark.read.schema(self._doc_schema(state.mapping)).parquet(*given))
        if not out:
            return self.spark.createDataFrame([], self._doc_schema(state.mapping))
        first, *others = out
        for x in others:
            first = first.unionByName(x)
        return first

    def delete_log(self, name: str, part: LogPart) -> None:
        self.files.delete(f"{self.folder(name)}/{part.path}" + (".json" if part.kind == "json" else ""))

    # -- segments -----------------------------------------------------------------------------------------------------

    def write_segment(self, name: str, number: int, tables: ix.IndexTables) -> str:
        """Writes the tables sorted, so that a lookup reads few row groups; a frequent token spans many files.

        Documents and their lengths are sorted file by file only: ids are given in the order of the log's files, so each
        file has few ids in common with others and an exchange would gain nothing.
        """
        folder = f"segments/{number:08d}-{uuid.uuid4().hex}"

        def write(table: str) -> None:
            order, df = ix.ORDER[table], getattr(tables, table)
            if table not in ("docs", "field_stats"):
                df = df.repartitionByRange(*order)
            df.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{self.folder(name)}/{folder}/{table}")

        with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables are jobs of their own and fill each other's gaps
            list(pool.map(write, TABLES))
        return folder

    def read_segments(self, name: str, state: State, segments: tuple[str, ...]) -> ix.IndexTables | None:
        if not segments:
            return None
        base = self.folder(name)
        read = {t: self.spark.read.parquet(*(f"{base}/{s}/{t}" for s in segments)) for t in TABLES if t != "docs"}
        # Fields that were added later are null in older files.
        read["docs"] = self.spark.read.schema(self._doc_schema(state.mapping)).parquet(*(f"{base}/{s}/docs" for s in segments))
        totals: dict[str, list[int]] = {}
        for s in segments:
            for f, (n, t) in state.lengths[s].items():
                so_far = totals.setdefault(f, [0, 0])
                so_far[0], so_far[1] = so_far[0] + n, so_far[1] + t
        rows = [(f, n, t) for f, (n, t) in totals.items()]
        read["lengths"] = local_table(self.spark, rows, "field string, n_docs bigint, total_tokens bigint")
        tables = ix.IndexTables(**read)
        if len(segments) == 1:
            return tables
        return replace(tables, trigrams=ix.first_tokens(tables.trigrams), grams=tables.grams.distinct())

    def tables(self, name: str, state: State | None = None) -> ix.IndexTables:
        """The whole index: segments, and the documents of the log analyzed as they are."""
        state = state or self.state(name)
        version, tables = self._opened.get(name, (0, None))
        if version == state.version:  # a version never changes: its files need not be looked up again
            return tables
        tables = self.read_segments(name, state, state.segments)
        if tables is None or state.log:
            fresh = ix.build(self.read_log(name, state), state.mapping)
            tables = fresh if tables is None else tables.union(fresh)
        self._opened[name] = (state.version, tables)
        return tables

    def flush(self, name: str, compact_at: int = COMPACT_AT) -> State:
        """Moves the log into a segment, merged with those that :func:`to_merge` names.  Documents that are added meanwhile
        stay in the log.  Nothing to move: no new version."""
        while True:
            state = self.state(name)
            if not state.log:
                return state
            new, changed = self._flushed(name, state, compact_at)

            def rebased(now: State) -> State | None:
                if now.segments != state.segments or now.log[: len(state.log)] != state.log:
                    return None  # another flush was first
                kept = replace(changed, mapping=now.mapping, max_doc_id=now.max_doc_id, streams=now.streams)
                return replace(kept, version=now.version, log=now.log[len(state.log) :])

            if done := self.change(name, rebased):
                return done
            self.files.delete(f"{self.folder(name)}/{new}")

    def _flushed(self, name: str, state: State, compact_at: int) -> tuple[str, State]:
        """The new segment, written, and the state that names it."""
        staging = f"{self.folder(name)}/staging/{uuid.uuid4().hex}"

        def stage(df: DataFrame) -> DataFrame:
            df.write.parquet(staging)
            return self.spark.read.parquet(staging)

        tables = ix.build(self.read_log(name, state), state.mapping, stage)
        size = sum(p.count for p in state.log)
        merged = to_merge(state.sizes, size, compact_at)
        kept = tuple(s for s in state.segments if s not in merged)
        if merged:
            old = tuple(s for s in state.segments if s in merged)
            tables = self.read_segments(name, state, old).union(tables)
        new = self.write_segment(name, state.next_segment, tables)
        self.files.delete(staging)
        stats = self.spark.read.parquet(f"{self.folder(name)}/{new}/field_stats")
        lengths = {r["field"]: [r["n_docs"], r["total_tokens"]] for r in ix.field_lengths(stats).collect()}
        lengths = {s: state.lengths[s] for s in kept} | {new: lengths}
        sizes = {s: state.sizes[s] for s in kept} | {new: size + sum(state.sizes[s] for s in merged)}
        return new, replace(state, segments=(*kept, new), log=(), next_segment=state.next_segment + 1, lengths=lengths, sizes=sizes)

    def vacuum(self, name: str) -> list[str]:
        """Deletes segments and logs that the newest manifest does not name, and all older manifests.  For times without
        writers and without readers of older versions."""
        state = self.state(name)
        live = {*state.segments, *(p.path for p in state.log)}
        dead = [f"{k}/{n}" for k in ("segments", "log", "staging") for n in self.files.names(f"{self.folder(name)}/{k}") if re.sub(r"\.json$", "", f"{k}/{n}") not in live]
        dead += [f"manifests/v{v:020d}.json" for v in self._versions(name) if v < state.version]  # from the oldest on
        for path in dead:
            self.files.delete(f"{self.folder(name)}/{path}")
        return dead
