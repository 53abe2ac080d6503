"""Registered queries of the core, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.analyze import tokens
from lodestone.mapping import Mapping
from lodestone.operators import blocks, incremental, index, layout, quantities, search, tree
from lodestone.operators.documents import parse_documents, result_json
from lodestone.plans.sources import DOCUMENTS, FUZZY, PARTS, PRODUCT_QUERIES, PRODUCTS, SEARCHES, Source
from lodestone.session import scratch_folder
from lodestone.sources.store import State, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str, source: Source) -> DataFrame:
    """``(doc_id, doc)`` of a source; ids are kept as they are."""
    rows = _table(spark, folder, source.table)
    if source.latest:
        newest = F.max(F.struct(source.latest, *source.fields)).alias("s")
        rows = rows.where(F.col(source.key).isNotNull()).groupBy(source.key).agg(newest).select(source.key, "s.*")
    doc = F.struct(*(F.col(c).cast("string" if t in ("Text", "Keyword") else "double" if t == "Number" else "boolean").alias(c) for c, t in source.fields.items()))
    return rows.select(F.col(source.key).cast("bigint").alias("doc_id"), doc.alias("doc"))


@cache
def _mapping(source: Source) -> Mapping:
    return Mapping.of([(c, t, False) for c, t in source.fields.items()])


def _index(spark: SparkSession, folder: str, source: Source) -> index.IndexTables:
    return index.build(_docs(spark, folder, source), _mapping(source))


def _cells(spark: SparkSession, folder: str, source: Source) -> DataFrame:
    return index.analyzed(_docs(spark, folder, source), _mapping(source))


def _ask(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, q string")


def _search(name: str, source: Source, texts: list[str], fuzzy: bool, mode: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = search.search_batch(_ask(spark, texts), _index(spark, folder, source), fuzzy, mode)
        return found.select("query_id", "doc_id", "score", "place")

    run.__name__ = name
    query(run)


for _name, (_source, _texts) in SEARCHES.items():
    _search(_name, _source, _texts, False, "first")
for _name, (_source, _texts, _mode) in FUZZY.items():
    _search(_name, _source, _texts, True, _mode)


# -- analysis and index tables --------------------------------------------------------------------------------------


@query
def tokenize_documents(spark, folder):
    rows = _table(spark, folder, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


@query
def keyword_tokens(spark, folder):
    cells = _cells(spark, folder, DOCUMENTS).where("field <> 'text'")
    return cells.select("doc_id", "field", F.col("tokens")[0].alias("token"))


@query
def term_frequency(spark, folder):
    return index.postings(_cells(spark, folder, DOCUMENTS)).select("field", "token", "doc_id", "tf")


@query
def postings_with_length(spark, folder):
    return _index(spark, folder, PRODUCTS).postings


@query
def field_stats(spark, folder):
    return index.field_stats(_cells(spark, folder, DOCUMENTS))


@query
def field_agg(spark, folder):
    found = index.field_aggregates(index.field_lengths(index.field_stats(_cells(spark, folder, DOCUMENTS))))
    return found.withColumn("avgdl", F.round("avgdl", 6))


@query
def document_frequency(spark, folder):
    return index.document_frequency(index.postings(_cells(spark, folder, DOCUMENTS)))


@query
def posting_lookup(spark, folder):
    return index.postings(_cells(spark, folder, DOCUMENTS)).where(F.col("token").isin("winter", "ferry", "en"))


@query
def project_source_fields(spark, folder):
    return _docs(spark, folder, PARTS).select("doc_id", "doc.*")


@query
def segment_statistics(spark, folder):
    """The newest segment, and what the stored statistics say of each segment and field."""
    stats = _table(spark, folder, "field_stats")
    return stats.groupBy("segment_id", "field").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("max_doc"))


@query
def newest_segment(spark, folder):
    return _table(spark, folder, "postings").agg(F.max("segment_id").alias("segment_id"))


@query
def current_postings(spark, folder):
    """Postings of several segments merged: the newest segment that has a document's entry counts."""
    rows = _table(spark, folder, "postings").where("token IS NOT NULL AND doc_id IS NOT NULL AND tf IS NOT NULL")
    newest = F.max(F.struct("segment_id", "tf")).alias("s")
    return rows.groupBy("field", "token", "doc_id").agg(newest).select("field", "token", "doc_id", "s.segment_id", "s.tf")


@query
def restricted_stats(spark, folder):
    """Statistics of the documents of one segment only."""
    own = _table(spark, folder, "postings").where("segment_id = 1").select("doc_id").distinct()
    return _table(spark, folder, "field_stats").join(own, "doc_id", "left_semi").select("field", "doc_id", "segment_id", "total_tokens")


@query
def trigram_index_first(spark, folder):
    return _index(spark, folder, PRODUCTS).trigrams.select("field", "trigram", "token")


@query
def trigram_index_full(spark, folder):
    return _index(spark, folder, PRODUCTS).grams


@query
def trigram_flatten(spark, folder):
    return search.flat_trigrams(_index(spark, folder, PRODUCTS).trigrams)


def _asked(spark: SparkSession) -> DataFrame:
    return search.query_terms(_ask(spark, PRODUCT_QUERIES))


@query
def fuzzy_candidates(spark, folder):
    """Tokens that share a trigram with a query token, before their distance is looked at."""
    found = search.alternatives(_asked(spark), _index(spark, folder, PRODUCTS), "full", 1_000)
    return found


@query
def fuzzy_expand(spark, folder):
    return search.expand(_asked(spark), _index(spark, folder, PRODUCTS), "full")


# -- search variants -------------------------------------------------------------------------------------------------


@query
def search_with_docs(spark, folder):
    built = _index(spark, folder, PARTS)
    hits = search.search_batch(_ask(spark, ["red widget", "small"]), built)
    return search.with_docs(hits, built.docs).select("query_id", "id", "score", "doc.*")


@query
def search_result_json(spark, folder):
    built = _index(spark, folder, PARTS)
    hits = search.with_docs(search.search_batch(_ask(spark, ["red widget"]), built), built.docs)
    return result_json(hits)


@query
def search_all_matches(spark, folder):
    """Every match of a conjunction, without the cut."""
    found = search.search_batch(_ask(spark, ["winter ferry"]), _index(spark, folder, DOCUMENTS), limit=None)
    return found.select("query_id", "doc_id", "score")


@query
def search_any_term(spark, folder):
    """Documents with at least one of the terms in a field."""
    found = search.search_batch(_ask(spark, ["winter ferry"]), _index(spark, folder, DOCUMENTS), limit=None, mode="or")
    return found.select("query_id", "doc_id", "score")


@query
def segment_union_search(spark, folder):
    """An index built in three parts, which together are all documents, searched as their union."""
    docs = _docs(spark, folder, DOCUMENTS)
    parts = [index.build(docs.where(F.pmod("doc_id", F.lit(3)) == k), _mapping(DOCUMENTS)) for k in range(3)]
    whole = reduce(lambda a, b: a.union(b), parts)
    found = search.search_batch(_ask(spark, SEARCHES["search_exact_and"][1]), whole)
    return found.select("query_id", "doc_id", "score", "place")


@query
def compaction_invariance(spark, folder):
    """All parts stored in three flushes, the last of which merges all segments, then searched from disk."""
    store = Store(spark, scratch_folder(spark, "store"))
    store.commit("parts", State(0, _mapping(PARTS)))
    docs = _docs(spark, folder, PARTS)
    for k in range(3):
        log = store.append_log("parts", docs.where(F.pmod("doc_id", F.lit(3)) == k))
        store.change("parts", lambda state: replace(state, log=(log,)))
        store.flush("parts", compact_at=2)
    found = search.search_batch(_ask(spark, SEARCHES["search_multi_field"][1]), store.tables("parts"))
    return found.select("query_id", "doc_id", "score", "place")


# -- log, segments, blocks ---------------------------------------------------------------------------------------------


@query
def wal_truncate(spark, folder):
    """Log entries that are newer than what the last successful run took."""
    runs, log = _table(spark, folder, "ingest_runs"), _table(spark, folder, "ingest_log")
    mark = runs.where("lower(trim(state)) = 'ok'").agg(F.max("window_to").alias("mark"))
    newer = log.withColumn("one", F.lit(1)).join(F.broadcast(mark.withColumn("one", F.lit(1))), "one")  # one row
    return newer.where("landed_at >= mark").select("log_pos", "doc_id")


@query
def memtable_antijoin(spark, folder):
    """Fields of documents with postings that have no statistics."""
    stats = _table(spark, folder, "field_stats").where("total_tokens IS NOT NULL")
    posted = _table(spark, folder, "postings").where("doc_id IS NOT NULL").select("field", "doc_id").distinct()
    return posted.join(stats, ["field", "doc_id"], "left_anti")


@query
def doc_id_intersection(spark, folder):
    """Documents that have both of two tokens in a field."""
    found = index.postings(_cells(spark, folder, DOCUMENTS))
    return found.where("token = 'winter'").select("field", "doc_id").intersect(found.where("token = 'ferry'").select("field", "doc_id"))


@query
def next_doc_id(spark, folder):
    """Ids for products in the order of their arrival, after the greatest id of the postings."""
    last = _table(spark, folder, "postings").agg(F.max("doc_id")).collect()[0][0] or 0
    rows = _table(spark, folder, "products").groupBy("doc_id").agg(F.min("arrived_at").alias("first_at")).withColumnRenamed("doc_id", "product")
    return index.number_documents(rows, last, ["first_at", "product"]).select("product", "doc_id")


@query
def delta_postings(spark, folder):
    return blocks.delta_postings(index.postings(_cells(spark, folder, PRODUCTS)))


@query
def delta_decode(spark, folder):
    """Gaps, encoded as bytes and decoded again, added up to the documents of each term."""
    entries = blocks.delta_entries(index.postings(_cells(spark, folder, PRODUCTS)))
    read = entries.select("field", "token", "place", blocks.from_varint(blocks.varint(F.col("delta"))).alias("delta"))
    return blocks.decode_postings(read)


@query
def varint_deltas(spark, folder):
    deltas = blocks.delta_postings(index.postings(_cells(spark, folder, PRODUCTS)))
    return deltas.select("field", "token", "doc_id", F.hex(blocks.varint(F.col("delta"))).alias("encoded"))


@query
def block_locations(spark, folder):
    """Where each block of terms begins in its field, and how many terms it has, from the beginnings alone."""
    found = blocks.token_blocks(index.postings(_cells(spark, folder, PRODUCTS)))
    begins = found.select(F.col("field").alias("section"), "block", (F.col("block") * blocks.TOKENS_PER_BLOCK).alias("offset"))
    return blocks.block_locations(begins, found.groupBy(F.col("field").alias("section")).agg(F.sum("n_tokens").alias("size")))


@query
def token_blocks(spark, folder):
    return blocks.token_blocks(index.postings(_cells(spark, folder, PRODUCTS)))


@query
def sparse_lookup_asof(spark, folder):
    found = blocks.token_blocks(index.postings(_cells(spark, folder, PRODUCTS)))
    return blocks.block_of_tokens(found, [r.token for r in _asked(spark).collect()])


@query
def doc_blocks(spark, folder):
    return blocks.doc_blocks(_docs(spark, folder, DOCUMENTS))


@query
def json_documents(spark, folder):
    """Documents of the log parsed under the stored mapping: accepted ones with their values, others with the error."""
    fields = _table(spark, folder, "mapping_fields").orderBy("field_id").collect()  # a few declared fields
    mapping = Mapping.of([(r.field_name, r.s_type, r.required) for r in fields])
    parsed = parse_documents(_table(spark, folder, "ingest_log"), mapping, "body", ("log_pos",))
    return parsed.select("log_pos", "doc.*", F.col("error").isNotNull().alias("rejected"))


@query
def json_rejects(spark, folder):
    """Why documents of the log are refused where all fields are required: the first thing that is wrong with each."""
    mapping = Mapping.of([("title", "Text"), ("category", "Keyword"), ("organic", "Bool"), ("price", "Number")])
    parsed = parse_documents(_table(spark, folder, "ingest_log"), mapping, "body", ("log_pos",))
    return parsed.where("error IS NOT NULL").select("log_pos", "error")


# -- statistics of an index --------------------------------------------------------------------------------------------


@query
def layout_summary(spark, folder):
    return layout.entry_counts(_index(spark, folder, DOCUMENTS))


@query
def layout_field_stats(spark, folder):
    return layout.field_lengths(index.field_stats(_cells(spark, folder, DOCUMENTS)))


@query
def layout_field_terms(spark, folder):
    return layout.field_terms(index.postings(_cells(spark, folder, DOCUMENTS)))


@query
def layout_top_tokens(spark, folder):
    return layout.top_tokens(index.postings(_cells(spark, folder, DOCUMENTS)))


@query
def layout_anchors(spark, folder):
    """The first blocks of terms of each stored segment."""
    rows = _table(spark, folder, "postings").where("token IS NOT NULL AND segment_id IS NOT NULL")
    return layout.term_anchors(rows.withColumnRenamed("segment_id", "segment"))


# -- operations on large collections -----------------------------------------------------------------------------------


@query
def p3_found(spark, folder):
    return tree.frequent_terms(_table(spark, folder, "postings")).select("field", "token")


@query
def p3_term_statistics(spark, folder):
    return tree.term_statistics(_table(spark, folder, "postings"))


@query
def p4_found(spark, folder):
    return p4_changes(spark, folder).select("doc_id")


@query
def p4_changes(spark, folder):
    runs = _table(spark, folder, "ingest_runs")
    return incremental.documents_to_process(spark, f"{folder}/ingest_log.parquet", runs, scratch_folder(spark, "p4"))


@query
def p5_found(spark, folder):
    return p5_contents(spark, folder).where("is_unique").select("doc_id", "base_unit", "amount")


@query
def p5_contents(spark, folder):
    return quantities.package_contents(*(_table(spark, folder, t) for t in ("products", "feeds", "unit_factors")))


@query
def p5_units(spark, folder):
    """The unit in which each source counts the length of its texts, from what the texts themselves are long."""
    rows = _table(spark, folder, "documents").select("source", "n_chars", F.length("text").alias("counted"))
    units = {"n_chars": {"char": 1.0, "dozen": 12.0, "thousand": 1000.0}, "counted": {"char": 1.0}}
    return quantities.infer_units(rows, "source", {"n_chars": 1, "counted": -1}, units).withColumn("residual", F.round("residual", 6))
