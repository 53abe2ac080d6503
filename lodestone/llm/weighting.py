"""How characteristic a term is of a record.

Two aggregations give every weight: one per term over the records (its spread), one per record or field (its length).

* ``log_entropy``: log2(1 + tf) times one minus the normalised entropy of the term's spread over the records,
  1 + sum(p log2 p) / log2 N with p = tf / total tf.  A term spread evenly over all N records weighs nothing, one that
  is in a single record keeps its whole local weight.
* ``bm25``: the score by which searches rank, k1 = 1.2 and b = 0.75, with the statistics of the field.

The entropy needs no second look at the rows: sum(p log2 p) = sum(tf log2 tf) / T - log2 T.

No step gathers a frequent term's records in one task.  Terms with more than a part in ``heavy_parts`` of all rows are
found first, by counts that are combined before they are exchanged; there cannot be more than ``heavy_parts``.  All rows
are then read once and exchanged once, by term, those of the frequent ones by term and a part of the documents; replays
are removed and the statistics taken where the rows arrive.  Statistics of frequent terms are put together from those of
the parts and broadcast, all others are joined where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.analyze import clean_term
from lodestone.functions.newest import Newest
from lodestone.session import hot_parts, small_side

K1, B = 1.2, 0.75
#: Up to this many fields are broadcast; a mapping has a few.
FIELDS = 10_000


def clean_postings(postings: DataFrame) -> DataFrame:
    """``(field, token, doc_id, key)`` of usable rows; see :func:`term_weights` for nulls and ties."""
    newest = Newest(postings.schema["segment_id"].dataType, postings.schema["tf"].dataType)
    rows = postings.where("field IS NOT NULL AND doc_id IS NOT NULL AND tf IS NOT NULL")
    return rows.select(
        "field", clean_term(F.col("token")).alias("token"), "doc_id", newest.key(F.col("segment_id"), F.col("tf")).alias("key")
    ).where("token IS NOT NULL")


def current_lengths(field_stats: DataFrame) -> DataFrame:
    """``(field, doc_id, dl)``: the entry with the highest segment of each field and document."""
    newest = Newest(field_stats.schema["segment_id"].dataType, field_stats.schema["total_tokens"].dataType)
    return (
        field_stats.where("field IS NOT NULL AND doc_id IS NOT NULL AND total_tokens IS NOT NULL")
        .groupBy("field", "doc_id")
        .agg(F.max(newest.key(F.col("segment_id"), F.col("total_tokens"))).alias("key"))
        .select("field", "doc_id", newest.value(F.col("key")).alias("dl"))
    )


def with_term_statistics(postings: DataFrame, heavy_parts: int | None = None) -> DataFrame:
    """``(field, token, doc_id, tf)`` of the current postings, with the term's ``df``, ``total`` (of tf) and ``tf_log_tf``
    (sum of tf log2 tf)."""
    parts = heavy_parts or hot_parts(postings.sparkSession)
    newest = Newest(postings.schema["segment_id"].dataType, postings.schema["tf"].dataType)
    rows, keys = clean_postings(postings), ["field", "token"]
    heavy = F.broadcast(heavy_terms(rows, parts)).withColumn("is_heavy", F.lit(True))
    # A term that is not heavy has one part only: -1.
    part = F.coalesce(F.when(F.col("is_heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")), F.lit(-1)).alias("part")
    spread = rows.join(heavy, keys, "left").select(*keys, part, "doc_id", "key").repartition(*keys, "part")
    newest = newest.value(F.max("key")).alias("tf")

    def current(condition: str) -> DataFrame:
        # A condition that may not be moved: it stays above the exchange, so that one exchange serves both kinds of terms.
        some = spread.where(F.monotonically_increasing_id() >= 0).where(condition)
        return some.groupBy(*keys, "part", "doc_id").agg(newest)

    tf = F.col("tf").cast("double")
    measures = [
        F.count("tf").alias("df"),  # not of rows: all who read the exchange have to need the same columns of it
        F.sum(F.col("tf").cast("bigint")).alias("total"),
        F.sum(F.when(tf > 0, tf * F.log2(tf)).otherwise(0.0)).alias("tf_log_tf"),
    ]
    names = ["df", "total", "tf_log_tf"]
    once, often = current("part < 0"), current("part >= 0")
    light = once.join(once.groupBy(*keys, "part").agg(*measures).hint("shuffle_hash"), [*keys, "part"])
    whole = often.groupBy(*keys, "part").agg(*measures).groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
    hot = often.join(F.broadcast(whole), keys)  # a row for each heavy term
    return light.select(*keys, "doc_id", "tf", *names).unionByName(hot.select(*keys, "doc_id", "tf", *names))


def heavy_terms(rows: DataFrame, parts: int) -> DataFrame:
    """``(field, token)`` of terms with more than one part in ``parts`` of ``rows(field, token)``; not more than ``parts``
    terms can have that, so they are held by the driver.  The total is counted by the same job."""
    seen = Observation()
    counted = rows.groupBy("field", "token").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("total"))
    top = counted.orderBy(F.col("n").desc(), "field", "token").limit(parts).collect()
    total = (seen.get["total"] or 0) if top else 0
    heavy = [(r["field"], r["token"]) for r in top if r["n"] * parts > total]
    return rows.sparkSession.createDataFrame(heavy, "field string, token string")


def term_weights(
    postings: DataFrame,
    field_stats: DataFrame,
    scheme: str = "log_entropy",
    k1: float = K1,
    b: float = B,
    heavy_parts: int | None = None,
) -> DataFrame:
    """``(field, token, doc_id, tf, df, weight)`` for every term and document of ``postings``.

    ``token`` is the cleaned form.  Rows with a null among field, token (or a blank token), doc_id and tf, and entries
    of ``field_stats`` with one among field, doc_id and total_tokens, are left out; then the highest ``segment_id``
    counts (of several rows there the greatest tf; a null segment is older than all others).  N and the mean length come
    from ``field_stats``; a document without an entry has length 0, a field without any has N 0 and mean length 1.
    Empty tables give no rows.  Further columns are not read.
    """
    if scheme not in ("log_entropy", "bm25"):
        raise ValueError("scheme must be log_entropy or bm25")
    lengths = current_lengths(field_stats)
    fields = small_side(lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), FIELDS)
    rows = with_term_statistics(postings, heavy_parts).join(fields, "field", "left")
    n, avgdl = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.nullif(F.col("avgdl"), F.lit(0.0)), F.lit(1.0))
    tf, df = F.col("tf").cast("double"), F.col("df")
    if scheme == "log_entropy":
        records = F.greatest(n, df)
        entropy = F.log2("total") - F.col("tf_log_tf") / F.col("total")
        spread = F.when((records > 1) & (F.col("total") > 0), entropy / F.log2(records)).otherwise(0.0)
        weight = F.when(tf > 0, F.log2(1 + tf) * (1 - spread)).otherwise(0.0)
    else:
        rows = rows.join(lengths, ["field", "doc_id"], "left")
        dl = F.coalesce(F.col("dl"), F.lit(0)).cast("double")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
        weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return rows.select("field", "token", "doc_id", "tf", "df", weight.alias("weight"))


def leading_terms(weights: DataFrame, factor: float = 2.0) -> DataFrame:
    """``(field, doc_id, token, weight, second)``: each document's best term of a field, if the document has two terms
    there and the best weighs at least ``factor`` times the second.  Documents with two equal best terms have none
    (unless both weigh 0: then the smaller token).  Only two rows of a document leave each task."""
    order = Window.partitionBy("field", "doc_id").orderBy(F.col("weight").desc(), "token")
    return (
        weights.select("field", "doc_id", "token", "weight", F.row_number().over(order).alias("place"))
        .where("place <= 2")
        .groupBy("field", "doc_id")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("token"))).alias("token"),
            F.max(F.when(F.col("place") == 1, F.col("weight"))).alias("weight"),
            F.max(F.when(F.col("place") == 2, F.col("weight"))).alias("second"),
        )
        .where(F.col("second").isNotNull() & (F.col("weight") >= factor * F.col("second")))
    )
