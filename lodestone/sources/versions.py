"""Tables as a sequence of immutable versions, and what changed between two of them.

A version is a manifest: the data files it consists of and, for some, a deletion vector, which lists rows of the file
that do not count.  Nothing that a manifest names is ever changed, so the difference of two versions follows from
the manifests alone: files added, files removed, and rows by which the deletion vectors of a file differ.  A consumer
writes the version it has processed into the manifest of its own output: results and progress become visible together,
and a run that fails at any point leaves both as they were.

Files are named by their URI, so a table may consist of files that others have written (:meth:`VersionedTable.register`).
A deletion vector is a table too: 64 rows of a file are a word of 64 bits.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.errors import FileError, ValidationError
from lodestone.sources.files import Files

CHANGE = "_change"
#: Deletion vectors of up to this many words are broadcast to the files' rows; larger ones are joined by file and word.
WORDS = 100_000


@dataclass(frozen=True)
class Manifest:
    """``files`` maps the URI of a data file to its deletion vector or None, ``words`` a vector to its number of words."""

    version: int
    schema: str | None = None
    files: dict[str, str | None] = field(default_factory=dict)
    processed: dict[str, int] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"format": 2, **self.__dict__}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(found["version"], found["schema"], found["files"], found["processed"], found["words"])

    @property
    def fields(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema)) if self.schema else StructType()


def mark_changes(rows: DataFrame, deleted_before: Column, deleted_after: Column) -> DataFrame:
    """Rows of files that are in two versions, with the column ``_change``: ``added`` or ``removed`` if the row counts in
    one version only, else null.  The deletion vectors are given as conditions; a null condition hides nothing."""
    before = ~F.coalesce(deleted_before, F.lit(False))
    after = ~F.coalesce(deleted_after, F.lit(False))
    return rows.withColumn(CHANGE, F.when(after & ~before, "added").when(before & ~after, "removed"))


def evolved(old: StructType, new: StructType) -> StructType:
    """The fields of a table after rows with other fields were added: new ones come last, and rows that lack a field have
    null there.  A field of another type, or a name that differs from a known one in case only, is refused."""
    known = {f.name: f for f in old.fields}
    lower = {n.lower(): n for n in known}
    added = []
    for f in new.fields:
        if f.name in known:
            if known[f.name].dataType != f.dataType:
                raise ValidationError(f"{f.name} is {known[f.name].dataType.simpleString()} and cannot become {f.dataType.simpleString()}")
        elif f.name.lower() in lower:
            raise ValidationError(f"{f.name} differs from {lower[f.name.lower()]} in case only")
        else:
            added.append(f)
            lower[f.name.lower()] = f.name
    return StructType([StructField(f.name, f.dataType) for f in (*old.fields, *added)])


class VersionedTable:
    """A table below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, words: int = WORDS):
        self.spark, self.root, self.files, self.words = spark, root.rstrip("/"), Files(spark), words

    def versions(self) -> list[int]:
        names = self.files.names(f"{self.root}/manifests")
        return [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, the latest by default; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0)
        path = self._path(version)
        if not self.files.exists(path):
            raise FileError(f"no version {version} in {self.root}")
        return Manifest.from_json(self.files.read(path))

    def _path(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:020d}.json"

    def _commit(self, old: Manifest, files: dict[str, str | None], schema: StructType | None = None, processed: dict[str, int] | None = None, words: dict[str, int] | None = None) -> int:
        """Writes the version after ``old``; an error if another run has written that."""
        live = {v for v in files.values() if v}
        sizes = {v: n for v, n in {**old.words, **(words or {})}.items() if v in live}
        described = json.dumps(schema.jsonValue()) if schema is not None else old.schema
        new = Manifest(old.version + 1, described, files, old.processed | (processed or {}), sizes)
        if not self.files.write_new(self._path(new.version), new.to_json()):
            raise FileError(f"version {new.version} of {self.root} was written by another run")
        return new.version

    def _write(self, df: DataFrame) -> dict[str, None]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return dict.fromkeys(_uris(self.spark.read.schema(df.schema).parquet(folder)))

    def append(self, df: DataFrame, processed: dict[str, int] | None = None) -> int:
        """A new version with the rows of ``df``; ``processed`` is saved by the same commit.  For other fields than those
        of the table see :func:`evolved`."""
        old = self.manifest()
        schema = evolved(old.fields, df.schema)
        return self._commit(old, old.files | self._write(df), schema, processed)

    def register(self, paths: str | list[str], hide: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """A new version with Parquet files that are there already, taken as they are: nothing is copied, and they must
        not be changed afterwards.

        ``hide`` is given the rows of these files, with ``_file`` and ``_row``, and returns those that shall not count.
        They go into deletion vectors; a file of which no row counts is left out of the version.  A file that the table
        has already gets what is said here in place of its vector.
        """
        old = self.manifest()
        read = self.spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
        schema, new = evolved(old.fields, read.schema), dict.fromkeys(_uris(read))
        files = {p: v for p, v in old.files.items() if p not in new}
        if hide is None:
            return self._commit(old, files | new, schema)
        rows = self._raw(list(new), schema)
        vector, hidden, n = self._write_vector(_bits(hide(rows)), new)
        total = {r["_file"]: r["n"] for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()}  # one row a file
        new = {p: vector if p in hidden else None for p in new if hidden.get(p, 0) < max(1, total.get(p, 0))}
        return self._commit(old, files | new, schema, words={vector: n})

    def delete(self, condition: Column) -> int:
        """A new version without the rows that meet the condition: their places go into deletion vectors."""
        old = self.manifest()
        bits = _bits(self._rows(old, list(old.files)).where(condition))
        before = sorted({v for v in old.files.values() if v})
        if before:
            both = bits.unionByName(self.spark.read.parquet(*(f"{self.root}/{v}" for v in before)))
            bits = both.groupBy("_file", "_word").agg(F.bit_or("_bits").alias("_bits"))
        vector, hidden, n = self._write_vector(bits, old.files)
        return self._commit(old, {p: vector if p in hidden else v for p, v in old.files.items()}, words={vector: n})

    def compact(self) -> int:
        """A new version with the same rows in new files, without deletion vectors."""
        old = self.manifest()
        return self._commit(old, dict(self._write(self.read(old.version))) if old.files else {})

    def _write_vector(self, bits: DataFrame, files: Iterable[str]) -> tuple[str, dict[str, int], int]:
        """The path of a new vector for rows of ``files``, the number of rows that it hides by file, and of its words."""
        vector = f"deleted/{uuid.uuid4().hex}"
        bits.write.parquet(f"{self.root}/{vector}")
        by_file = self.spark.read.parquet(f"{self.root}/{vector}").groupBy("_file")
        rows = by_file.agg(F.sum(F.bit_count("_bits")).alias("rows"), F.count("*").alias("words")).collect()  # one row a file
        if strange := {r["_file"] for r in rows} - set(files):
            raise FileError(f"the scan names files otherwise than the manifest: {min(strange)}")
        return vector, {r["_file"]: r["rows"] for r in rows}, sum(r["words"] for r in rows)

    def _raw(self, paths: list[str], schema: StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema).select("*", F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_row"))
        read = self.spark.read.schema(schema).parquet(*map(unquote, paths))
        return read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _marked(self, rows: DataFrame, manifest: Manifest, paths: list[str], name: str) -> DataFrame:
        """``rows`` with a column that is true for rows that the vectors of these files hide."""
        vectors = sorted({v for p in paths if (v := manifest.files[p])})
        if not vectors:
            return rows.withColumn(name, F.lit(False))
        bits = self.spark.read.parquet(*(f"{self.root}/{v}" for v in vectors))
        if len(vectors) > 1:  # the vectors of some files may have been replaced: of the others only what belongs to a file
            own = self.spark.createDataFrame([(p, manifest.files[p]) for p in paths if manifest.files[p]], "_file string, _vector string")
            told = F.concat(F.lit("deleted/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).alias("_vector")
            bits = bits.select("*", told).join(own, ["_file", "_vector"], "left_semi").drop("_vector")
        if sum(manifest.words[v] for v in vectors) <= self.words:  # counted when they were written
            bits = F.broadcast(bits)
        marked = rows.withColumn("_word", F.shiftright("_row", 6)).join(bits, ["_file", "_word"], "left")
        hit = F.expr("(shiftrightunsigned(_bits, CAST(_row & 63 AS INT)) & 1) = 1")
        return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_word", "_bits")

    def _rows(self, manifest: Manifest, paths: list[str], schema: StructType | None = None) -> DataFrame:
        rows = self._marked(self._raw(paths, schema or manifest.fields), manifest, paths, "_hidden")
        return rows.where("NOT _hidden").drop("_hidden")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        manifest = self.manifest(version)
        return self._rows(manifest, list(manifest.files)).drop("_file", "_row")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that were ``added`` or ``removed`` (column ``_change``) from version ``since`` to ``until``.

        Only files that are in one of the two versions, or whose deletion vector differs, are read.  A row that merely
        moved to another file comes out as removed and as added; :func:`net_changes` takes such pairs away.
        """
        a, b = self.manifest(since), self.manifest(until)
        schema = b.fields if b.schema else a.fields
        gone = [p for p in a.files if p not in b.files]
        new = [p for p in b.files if p not in a.files]
        both = [p for p in b.files if p in a.files and a.files[p] != b.files[p]]
        out = [self._rows(m, paths, schema).withColumn(CHANGE, F.lit(how)) for m, paths, how in ((b, new, "added"), (a, gone, "removed")) if paths]
        if both:
            rows = self._marked(self._marked(self._raw(both, schema), a, both, "_before"), b, both, "_after")
            marked = mark_changes(rows, F.col("_before"), F.col("_after")).where(F.col(CHANGE).isNotNull())
            out.append(marked.drop("_before", "_after"))
        if not out:
            out.append(self._raw([], schema).withColumn(CHANGE, F.lit(None).cast("string")))
        first, *others = [x.drop("_file", "_row") for x in out]
        for x in others:
            first = first.unionByName(x)
        return first


def _uris(read: DataFrame) -> list[str]:
    """The files of a scan as ``_metadata.file_path`` names them: one slash where a URI has no host."""
    return [re.sub(r"^(\w+):///", r"\1:/", uri) for uri in read.inputFiles()]


def _bits(rows: DataFrame) -> DataFrame:
    """The places of ``rows(_file, _row)`` as words; combined where they are read."""
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(_row & 63 AS INT))")
    return rows.groupBy("_file", F.shiftright("_row", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def net_changes(changes: DataFrame) -> DataFrame:
    """Changes without pairs of a removed and an added row that are equal; ``_copies`` tells how often a row changed."""
    columns = [c for c in changes.columns if c != CHANGE]
    sign = F.when(F.col(CHANGE) == "added", 1).otherwise(-1)
    return (
        changes.groupBy(*columns)
        .agg(F.sum(sign).alias("n"))
        .where("n <> 0")
        .select(*columns, F.when(F.col("n") > 0, "added").otherwise("removed").alias(CHANGE), F.abs("n").alias("_copies"))
    )


def process_changes(
    source: VersionedTable,
    target: VersionedTable,
    transform: Callable[[DataFrame], DataFrame],
    name: str = "source",
) -> int | None:
    """Appends to ``target`` what ``transform`` makes of the changes of ``source`` since the version that ``target`` has
    recorded under ``name``, and records the new version in the same commit.

    None, and nothing is run, if there is no new version.  If the run fails or loses against another one, no version of
    the target exists that holds a part of its output, and the next run starts from the same changes.
    """
    done, latest = target.manifest().processed.get(name, 0), source.manifest().version
    if latest == done:
        return None
    return target.append(transform(source.changes(done, latest)), {name: latest})
