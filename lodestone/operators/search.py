"""Ranked search: all query tokens in one field, BM25 per field, scores summed over fields.

Queries are rows, so that one plan answers one query or thousands.  Terms are few (bounded by the queries' lengths);
postings are the large side and are reduced to the queries' tokens before anything else happens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.functions.analyze import tokens, trigrams
from lodestone.operators.index import IndexTables, field_aggregates
from lodestone.session import hot_parts, local_table

LIMIT, K1, B = 100, 1.2, 0.75
#: Up to this many terms are held by the driver and broadcast; more stay a table and are joined as Spark sees fit.
LOCAL_TERMS = 100_000
#: Up to this many tokens or ids are named in the condition of a scan, which then skips what has none of them.
NAMED = 1_000


def bm25(tf: Column, dl: Column, df: Column, n_docs: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    tf, dl = tf.cast("double"), dl.cast("double")
    idf = F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, n_terms, term_pos, token)`` of ``queries(query_id, q)``; a repeated token is a term each time."""
    split = queries.select("query_id", tokens(F.col("q")).alias("toks"))
    return split.select("query_id", F.size("toks").alias("n_terms"), F.posexplode("toks").alias("term_pos", "token"))


def literal_terms(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    """:func:`query_terms` of queries that the driver has: the same rule, without a job."""
    rows = []
    for number, text in queries:
        split = [t.lower() for t in re.findall("[A-Za-z0-9]+", text)]
        rows += [(number, len(split), i, t) for i, t in enumerate(split)]
    return local_table(spark, rows, "query_id int, n_terms int, term_pos int, token string")


def flat_trigrams(first: DataFrame) -> DataFrame:
    """``(trigram, token)`` over all fields: of several fields the one whose name sorts first decides."""
    return first.groupBy("trigram").agg(F.min_by("token", "field").alias("token"))


def alternatives(
    terms: DataFrame, index: IndexTables, trigram_mode: str = "first", distance: int = 1, local_terms: int = LOCAL_TERMS
) -> DataFrame:
    """``(token, alternative)`` for the distinct tokens of ``terms``: indexed tokens that share a trigram and differ by at
    most ``distance`` edits.  ``first`` knows one token per trigram, ``full`` all of them."""
    if trigram_mode not in ("first", "full"):
        raise ValueError("trigram_mode must be first or full")
    asked = terms.select("token").distinct().select("token", F.explode(F.array_distinct(trigrams(F.col("token")))).alias("trigram"))
    known = index.trigrams if trigram_mode == "first" else index.grams
    rows = asked.limit(local_terms + 1).collect()
    few = len(rows) <= local_terms
    if few:
        asked = F.broadcast(local_table(terms.sparkSession, rows, asked.schema))
        wanted = sorted({r["trigram"] for r in rows})
        if len(wanted) <= NAMED:
            known = known.where(F.col("trigram").isin(wanted))
    known = flat_trigrams(known) if trigram_mode == "first" else known.select("trigram", "token").distinct()
    known = known.withColumnRenamed("token", "alternative")
    joined = known.join(asked, "trigram") if few else spread_join(known, asked, "trigram", "alternative")
    return (
        joined
        .where(F.levenshtein("token", "alternative", distance) >= 0)
        .select("token", "alternative")
        .distinct()
    )


def expand(
    terms: DataFrame, index: IndexTables, trigram_mode: str = "first", distance: int = 1, local_terms: int = LOCAL_TERMS
) -> DataFrame:
    """``terms`` with further rows for the alternatives of each token; the token itself always stays."""
    found = alternatives(terms, index, trigram_mode, distance, local_terms)
    more = terms.join(found, "token").select("query_id", "n_terms", "term_pos", F.col("alternative").alias("token"))
    return terms.unionByName(more).distinct()


def spread_join(large: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """``large.join(small, key)`` where neither side can be broadcast and a few keys may hold much of ``large``.

    Keys with more than one part in :func:`~lodestone.session.hot_parts` of the rows are counted first (there are not more
    than that many).  Their rows in ``large`` are spread over that many tasks by the column ``by``, and what ``small`` has
    of them is repeated as often; all others are joined by key.
    """
    spark, parts = large.sparkSession, hot_parts(large.sparkSession)
    seen = Observation()
    counted = large.groupBy(key).agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("total"))
    largest = counted.orderBy(F.col("n").desc(), key).limit(parts).collect()
    hot = [(r[key], parts) for r in largest if r["n"] * parts > seen.get["total"]]
    spreads = F.broadcast(local_table(spark, hot, StructType([large.schema[key], StructField("_parts", IntegerType())])))
    place = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).otherwise(0)
    places = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    left = large.join(spreads, key, "left").withColumn("_place", place).drop("_parts")
    right = small.join(spreads, key, "left").withColumn("_place", places).drop("_parts")
    return left.join(right, [key, "_place"]).drop("_place")


def score(
    terms: DataFrame,
    postings: DataFrame,
    aggregates: DataFrame,
    k1: float = K1,
    b: float = B,
    mode: str = "and",
    few_terms: bool = False,
    exact: bool = False,
) -> DataFrame:
    """``(query_id, doc_id, score)`` of all matches of ``terms(query_id, n_terms, term_pos, token)``.

    The rows of one ``term_pos`` are alternatives of one term: a document counts once, with the frequency of the smallest
    of its tokens, and the document frequency of the term is the number of such documents in the field.

    Hits are exchanged once, by query and document; all that follows per document stays where it is.  ``few_terms`` tells
    that the terms have been counted and are few: then they and their document frequencies are broadcast.  ``exact`` tells
    that no term has alternatives: then each hit is a match by itself.
    """
    small = F.broadcast if few_terms else (lambda df: df)
    found = postings.join(small(terms), "token") if few_terms else spread_join(postings, terms, "token", "doc_id")
    hits = found.repartition("query_id", "doc_id")
    keys, m = ["query_id", "n_terms", "field", "term_pos", "doc_id"], F.struct("token", "tf", "dl").alias("m")
    per_term = hits.select(*keys, m) if exact else hits.groupBy(*keys).agg(F.min(m).alias("m"))
    if exact:  # counted where the hits are read
        frequency = found.groupBy("query_id", "field", "term_pos").agg(F.count("*").alias("df"))
    else:  # counting m instead of rows keeps the columns of the exchange, so that it is run once and read twice
        frequency = per_term.groupBy("query_id", "field", "term_pos").agg(F.count("m").alias("df"))
    # One row per field of the mapping.
    weighed = per_term.join(small(frequency), ["query_id", "field", "term_pos"]).join(F.broadcast(aggregates), "field")
    weight = bm25(F.col("m.tf"), F.col("m.dl"), F.col("df"), F.col("n_docs"), F.coalesce(F.nullif("avgdl", F.lit(0.0)), F.lit(1.0)), k1, b)
    per_field = (
        weighed.groupBy("query_id", "n_terms", "field", "doc_id")
        .agg(F.sum(weight).alias("s"), F.count("*").alias("k"))
        .where("k = n_terms" if mode == "and" else "k > 0")
    )
    return per_field.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def top(scored: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """The best documents of each query: score falling, then doc_id rising; ``place`` from 1.  Each task keeps ``limit``
    rows of a query before they are exchanged.  Without a limit all matches are returned and not ranked: ``place`` is null."""
    if limit is None:
        return scored.select("query_id", "doc_id", "score", F.lit(None).cast("int").alias("place"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.select("query_id", "doc_id", "score", F.row_number().over(order).alias("place")).where(F.col("place") <= limit)


def search_batch(queries: DataFrame, index: IndexTables, fuzzy: bool = False, *args, **options) -> DataFrame:
    """``(query_id, doc_id, score, place)`` for ``queries(query_id, q)``; options as in :func:`search_terms`.  A query without
    tokens has no hits."""
    return search_terms(query_terms(queries), index, fuzzy, *args, **options)


def search_terms(
    terms: DataFrame,
    index: IndexTables,
    fuzzy: bool = False,
    trigram_mode: str = "first",
    limit: int | None = LIMIT,
    k1: float = K1,
    b: float = B,
    mode: str = "and",
    fields: list[str] | None = None,
    distance: int = 1,
    local_terms: int = LOCAL_TERMS,
) -> DataFrame:
    """``(query_id, doc_id, score, place)`` for the terms of queries, see :func:`query_terms`."""
    if fuzzy:
        terms = expand(terms, index, trigram_mode, distance, local_terms)
    postings = index.postings
    if fields is not None:
        postings = postings.where(F.col("field").isin(fields))
    rows = terms.limit(local_terms + 1).collect()
    few = len(rows) <= local_terms
    if few:
        terms = local_table(terms.sparkSession, rows, terms.schema)
        wanted = sorted({r["token"] for r in rows})
        if len(wanted) <= NAMED:
            postings = postings.where(F.col("token").isin(wanted))
    return top(score(terms, postings, field_aggregates(index.lengths), k1, b, mode, few, not fuzzy), limit)


def with_docs(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits joined to their documents, after the cut.  Hits without a document are dropped.

    Few hits are held by the driver and their ids named in the scan of the documents; more are joined as Spark sees fit.
    """
    rows = hits.limit(NAMED + 1).collect()
    if len(rows) <= NAMED:
        hits = F.broadcast(local_table(hits.sparkSession, rows, hits.schema))
        docs = docs.where(F.col("doc_id").isin(sorted({r["doc_id"] for r in rows})))
    return docs.join(hits, "doc_id").select("query_id", F.col("doc_id").alias("id"), "score", "place", "doc")
