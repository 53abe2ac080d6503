"""The engine: create an index, add documents, search, flush."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ParseError, ValidationError
from lodestone.mapping import Field, Mapping, check_name
from lodestone.operators import layout as lay
from lodestone.operators import search as se
from lodestone.operators.documents import Undecided, parse_document, parse_documents, result_json, typed_documents
from lodestone.operators.index import IndexTables
from lodestone.sources.store import COMPACT_AT, TABLES, LogPart, State, Store

#: Up to this many documents of a list are checked and written by the driver, without a job.
DRIVER_DOCS = 1_000


class Engine:
    """Indexes below ``root``.  Opening an engine on a folder recovers whatever was committed there."""

    def __init__(self, spark: SparkSession, root: str, compact_at: int = COMPACT_AT):
        self.spark, self.store, self.compact_at = spark, Store(spark, root), compact_at

    def index_names(self) -> list[str]:
        return self.store.names()

    def mapping(self, name: str) -> Mapping:
        return self.store.state(name).mapping

    def create_index(self, name: str, mapping: Any) -> dict[str, str]:
        parsed = Mapping.of(mapping)
        parsed.validate(check_name(name), self.store.names())
        self._check_case(parsed)
        self.store.commit(name, State(0, parsed))
        return {"status": "created"}

    def _check_case(self, mapping: Mapping) -> None:
        """Fields may differ in case only, if the session tells such columns apart."""
        different = len({f.name.lower() for f in mapping.fields}) == len(mapping.fields)
        if not different and self.spark.conf.get("spark.sql.caseSensitive") != "true":
            raise ValidationError("field names that differ in case only need spark.sql.caseSensitive=true")

    def update_mapping(self, name: str, new_field: Field | dict | tuple) -> dict[str, str]:
        """Adds a field; documents that are there do not have it."""

        def added(state: State) -> State:
            changed = state.mapping.with_field(new_field)
            self._check_case(changed)
            return replace(state, mapping=changed)

        self.store.change(name, added)
        return {"status": "mapping_updated"}

    def index_docs(
        self,
        name: str,
        docs: Any,
        on_error: str = "raise",
        stream: tuple[str, int] | None = None,
        rejects: str | None = None,
    ) -> dict[str, Any]:
        """Adds documents: a dict or JSON text, a list of them, a DataFrame with one string column ``json``, or one with
        a column per field.  Accepted documents get consecutive ids in the given order (DataFrames in that of their tasks).

        With ``raise`` one rejected document rejects all; with ``skip`` the others are taken and the number of rejected
        ones is told.  ``rejects`` is a folder into which rejected documents go, as JSON lines ``text`` and ``error``, before
        the others are committed.  ``stream`` names the batch of a stream: one that was taken before changes nothing.

        Several threads and processes may add documents at a time: what was written is committed after what others have
        committed meanwhile, with the ids that follow.
        """
        if on_error not in ("raise", "skip"):
            raise ValueError("on_error must be raise or skip")
        while True:
            state = self.store.state(name)
            if stream and state.streams.get(stream[0], -1) >= stream[1]:
                return {"status": "indexed", "accepted": 0, "rejected": 0}
            part, n_rejected = self._written(name, state.mapping, docs, on_error, rejects)
            if not part.count and not stream:
                self.store.delete_log(name, part)
                return {"status": "indexed", "accepted": 0, "rejected": n_rejected}

            def added(now: State) -> State | None:
                if now.mapping != state.mapping or (stream and now.streams.get(stream[0], -1) >= stream[1]):
                    return None  # to be checked anew, or taken by another run
                streams = now.streams | ({stream[0]: stream[1]} if stream else {})
                if not part.count:
                    return replace(now, streams=streams)
                mine = replace(part, first=now.max_doc_id + 1)
                return replace(now, log=(*now.log, mine), max_doc_id=now.max_doc_id + part.count, streams=streams)

            done = self.store.change(name, added)
            if not (done and part.count):
                self.store.delete_log(name, part)
            if done:
                return {"status": "indexed", "accepted": part.count, "rejected": n_rejected}

    def _written(self, name: str, mapping: Mapping, docs: Any, on_error: str, rejects: str | None) -> tuple[LogPart, int]:
        """A part of the log with the accepted documents, and the number of the others."""
        if not isinstance(docs, DataFrame):
            docs = [docs] if isinstance(docs, (dict, str)) else list(docs)
            texts = [d if isinstance(d, str) else json.dumps(d, ensure_ascii=False) for d in docs]
            if len(texts) <= DRIVER_DOCS:
                try:
                    return self._written_here(name, [(t, *parse_document(t, mapping)) for t in texts], on_error, rejects)
                except Undecided:
                    pass
            docs = self.spark.createDataFrame([(t,) for t in texts], "json string")
        if docs.columns[0] == "json" and docs.schema["json"].dataType.simpleString() == "string":
            parsed = parse_documents(docs, mapping, "json", ("json",)).withColumnRenamed("json", "text")
        else:
            parsed = typed_documents(docs, mapping).withColumn("text", F.lit(None).cast("string"))
        rejected, n_rejected = parsed.where("error IS NOT NULL").select("text", "error"), 0
        if on_error == "raise":
            first = rejected.take(1)
            if first:
                raise ParseError(first[0]["error"])
        elif rejects:
            rejected.write.mode("overwrite").json(rejects)
            n_rejected = self.spark.read.schema("error string").json(rejects).count()
        else:
            n_rejected = rejected.count()
        return self.store.append_log(name, parsed.where("error IS NULL").select("doc")), n_rejected

    def _written_here(self, name: str, parsed: list[tuple], on_error: str, rejects: str | None) -> tuple[LogPart, int]:
        bad = [(text, error) for text, _, error in parsed if error]
        if bad and on_error == "raise":
            raise ParseError(bad[0][1])
        if rejects:
            self.store.files.delete(rejects)
            lines = [json.dumps({"text": t, "error": e}, ensure_ascii=False) + "\n" for t, e in bad]
            self.store.files.write(f"{rejects}/part-00000.json", "".join(lines))
        return self.store.append_lines(name, [doc for _, doc, error in parsed if not error]), len(bad)

    def tables(self, name: str) -> IndexTables:
        return self.store.tables(name)

    def search(self, name: str, query: str, fuzzy: bool = False, **options: Any) -> DataFrame:
        """``(id, score, doc)``, best first, at most 100; options as in :func:`lodestone.operators.search.search_batch`."""
        index = self.tables(name)
        hits = se.search_terms(se.literal_terms(self.spark, [(0, query)]), index, fuzzy, **options)
        found = se.with_docs(hits, index.docs)
        if options.get("limit", se.LIMIT) is not None:  # a page: one task, no ranges to be drawn
            return found.repartition(1).sortWithinPartitions("place").select("id", "score", "doc")
        return found.select("id", "score", "doc")

    def search_batch(self, name: str, queries: DataFrame, fuzzy: bool = False, docs: bool = False, **options: Any) -> DataFrame:
        """``(query_id, doc_id, score, place)`` for ``queries(query_id, q)``, with ``docs`` the documents too."""
        index = self.tables(name)
        hits = se.search_batch(queries, index, fuzzy, **options)
        return se.with_docs(hits, index.docs) if docs else hits

    def search_json(self, name: str, query: str, fuzzy: bool = False, **options: Any) -> str:
        """``{"results": [...]}`` of one query, for a page of results: a limit has to be given if another than the usual."""
        if options.get("limit", se.LIMIT) is None:
            raise ValueError("all matches do not go into one text: use search")
        rows = result_json(self.search(name, query, fuzzy, **options)).collect()
        return '{"results":[' + ",".join(r["json"] for r in rows) + "]}"

    def flush(self) -> None:
        """Moves the logs of all indexes into segments; results stay the same."""
        for name in self.store.names():
            self.store.flush(name, self.compact_at)

    def layout(self, name: str) -> dict[str, DataFrame]:
        """Statistics of an index: summary, mapping, field_stats, entries, field_terms, top_tokens; of its segments, newest
        first, the facts, the tables with their place and size, and the first anchors of terms and documents; the log."""
        state, index = self.store.state(name), self.tables(name)
        base = self.store.folder(name)
        newest, sizes = tuple(reversed(state.segments)), []
        for s in newest:
            end = 0
            for t in TABLES:
                found = [n for p, n in self.store.files.sizes(f"{base}/{s}/{t}").items() if p.endswith(".parquet")]
                sizes.append((s, t, len(found), end, end := end + sum(found), sum(found)))
        log_size = sum(sum(self.store.files.sizes(f"{self.store.folder(name)}/{p.path}" + (".json" if p.kind == "json" else "")).values()) for p in state.log)
        logged = self.store.read_log(name, state)
        create = self.spark.createDataFrame
        facts = [(s, state.sizes[s], sum(x[-1] for x in sizes if x[0] == s)) for s in newest]
        last = lay.last_documents({s: self.spark.read.schema("doc_id bigint").parquet(f"{base}/{s}/docs") for s in newest}, self.spark)
        terms = lay.segment_terms({s: self.spark.read.parquet(f"{base}/{s}/postings") for s in newest}, self.spark)
        facts = create(facts, "segment string, documents bigint, bytes bigint").join(last, "segment", "left").orderBy(F.col("segment").desc())
        summary = [
            ("segments", len(state.segments)), ("segment_bytes", sum(x[-1] for x in sizes)), ("log_bytes", log_size),
            ("max_doc_id", state.max_doc_id), ("fields", len(state.mapping.fields)),
        ]
        counts = index.docs.agg(F.lit("documents").alias("name"), F.count("*").alias("value")).unionByName(
            logged.agg(F.lit("log_documents").alias("name"), F.count("*").alias("value"))
        )
        return {
            "summary": create(summary, "name string, value bigint").unionByName(counts),
            "mapping": create([(f.name, f.s_type, f.required) for f in state.mapping.fields], "field string, type string, required boolean"),
            "field_stats": lay.field_lengths(index.field_stats),
            "entries": lay.entry_counts(index),
            "field_terms": lay.field_terms(index.postings),
            "top_tokens": lay.top_tokens(index.postings),
            "segments": facts,
            "segment_tables": create(sizes, "segment string, table string, files int, start bigint, end bigint, bytes bigint"),
            "term_anchors": lay.term_anchors(terms).orderBy(F.col("segment").desc(), "block"),
            "doc_anchors": lay.doc_anchors({s: self.spark.read.schema("doc_id bigint").parquet(f"{base}/{s}/docs") for s in newest}, self.spark),
            "log": logged.orderBy(F.col("doc_id").desc()).limit(3),
        }
