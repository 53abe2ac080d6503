"""How often every term occurs in a collection, and in how many records.

Heavy-light aggregation.  The lists of a few terms hold much of all entries; the lists of the others fit a task.

* Heavy terms are found by local counts (each task keeps only terms with a share of its own entries) and broadcast:
  at most ``2 * heavy_parts`` of them, so their size follows the number of tasks and not the data.
* Entries of heavy terms are merged where they are read, into arrays of exact counters per heavy term, one cell a
  record, which hold the current frequency.  The arrays travel by term and range of records, so that a term fills many
  tasks: a record may be listed again by an entry elsewhere, and counts once.  They are merged by the same kernel and
  leave one row per term and task.
* All other terms are shuffled by term with their lists unopened: one exchange serves the removal of repeated records
  and the counts.

The two tables of counts are then united.  Which way a term takes never changes its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analyze import clean_term
from lodestone.functions.newest import Newest
from lodestone.session import hot_parts, small_side

RARE_DOCS = 1
COMMON_SHARE = 0.2
#: Up to this many fields are broadcast; a mapping has a few.
FIELDS = 10_000
#: Cells that a task holds before it merges them.
CELLS = 1 << 20
#: Rows that a task holds before it groups them.
ROWS = 1 << 17
#: Records per array that travels.
RANGE_BITS = 16


def _local_shares(parts: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def summed(tables: list) -> pa.Table:
            sums = pa.concat_tables(tables).group_by(["field_id", "token"]).aggregate([("n", "sum")])
            return sums.rename_columns({"n_sum": "n"}).select(["field_id", "token", "n"])

        tables, n, limit = [], 0, ROWS
        for batch in batches:
            tables.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= limit:  # what is held is grouped anew only when it has doubled
                tables = [summed(tables)]
                n = len(tables[0])
                limit = max(ROWS, 2 * n)
        if not tables:
            return
        held = summed(tables)
        total = pc.sum(held["n"]).as_py()
        heavy = held.filter(pc.greater(held["n"], total // (2 * parts)))
        yield from heavy.append_column("total", pa.array([0] * len(heavy), pa.int64())).to_batches()
        yield pa.RecordBatch.from_pylist([{"n": 0, "total": total}], schema=heavy.schema.append(pa.field("total", pa.int64())))

    return run


def heavy_terms(entries: DataFrame, parts: int) -> DataFrame:
    """Terms ``(field_id, token, term)`` of ``entries(field_id, token, docs)`` with more than one part in ``parts`` of
    all entries, perhaps also some with half of that: at most ``2 * parts`` rows, held by the driver.  ``term`` is a
    number that stands for the term."""
    sizes = entries.select("field_id", "token", F.size("docs.doc_id").cast("bigint").alias("n"))
    local = sizes.mapInArrow(_local_shares(parts), "field_id int, token string, n bigint, total bigint")
    # A task leaves out a term only if it has less than a 2 * parts-th of the task's entries, so no term with one part
    # in ``parts`` of all can be lost.  The row without a term has the total.
    shares = local.groupBy("field_id", "token").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    top = shares.orderBy(F.col("token").isNotNull(), F.col("n").desc()).limit(2 * parts + 1).collect()
    total = sum(r["total"] for r in top)
    heavy = [(r["field_id"], r["token"], i) for i, r in enumerate(top) if r["token"] is not None and r["n"] * 2 * parts > total]
    return entries.sparkSession.createDataFrame(heavy, "field_id int, token string, term bigint")


def _combine(cells: int):
    def run(batches: Iterator) -> Iterator:
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
            n += batch.num_rows
            if n >= cells:
                held = [_current(held)]
                n = len(held[0][0])
                if 2 * n > cells:
                    yield _arrays(held[0])
                    held, n = [], 0
        if n:
            yield _arrays(_current(held))

    return run


def _current(held: list):
    """Of all cells (term, record, segment, tf), the one with the greatest segment, then tf, of each term and record."""
    import numpy as np

    columns = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    term, doc, segment, tf = (x[order] for x in columns)
    keep = np.append((term[1:] != term[:-1]) | (doc[1:] != doc[:-1]), True)
    return term[keep], doc[keep], segment[keep], tf[keep]


def _arrays(current):
    """One row per term and range of records, with arrays of its cells."""
    import numpy as np
    import pyarrow as pa

    term, doc, segment, tf = current
    part = doc >> RANGE_BITS
    begins = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1])))
    offsets = pa.array(np.append(begins, len(term)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (doc, segment, tf)]
    return pa.RecordBatch.from_arrays(
        [pa.array(term[begins]), pa.array(part[begins]), *lists], names=["term", "part", "docs", "segments", "tfs"]
    )


def _count(cells: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, n, limit = [], 0, cells
        for batch in batches:
            lists = [batch.column(i) for i in (2, 3, 4)]
            lengths = np.diff(lists[0].offsets.to_numpy())
            held.append((np.repeat(batch.column(0).to_numpy(), lengths), *(x.flatten().to_numpy() for x in lists)))
            n += int(lengths.sum())
            if n >= limit:
                held = [_current(held)]
                n = len(held[0][0])
                limit = 2 * n + cells
        if n:
            term, _, _, tf = _current(held)
            begins = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[begins]), pa.array(np.add.reduceat(tf, begins)), pa.array(np.diff(np.append(begins, len(term))))],
                names=["term", "total_tf", "n_docs"],
            )

    return run


def entries_of(token_entries: DataFrame) -> DataFrame:
    """``(field_id, token, segment_id, docs)`` with cleaned terms; entries without a field, a term or a list are left
    out, they name no term or list nothing."""
    return (
        token_entries.select("field_id", clean_term(F.col("token")).alias("token"), "segment_id", "docs")
        .where("field_id IS NOT NULL AND token IS NOT NULL AND size(docs) > 0")
    )


def term_counts(token_entries: DataFrame, heavy_parts: int | None = None, cells: int = CELLS) -> DataFrame:
    """``(field_id, token, total_tf, n_docs)`` for every term of ``token_entries(segment_id, field_id, token, docs)``.

    ``token`` is the cleaned form.  A record counts once per term, with the frequency that the highest ``segment_id``
    gives it (of several there the greatest; a null segment is older than all others); ``posting_count`` is not read.
    Elements of ``docs`` without a ``doc_id`` are left out, a null ``tf`` counts as 0.  An empty table gives no rows.
    """
    entries = entries_of(token_entries)
    heavy = heavy_terms(entries, heavy_parts or hot_parts(entries.sparkSession))
    keys = ["field_id", "token"]
    opened = F.explode("docs").alias("d")
    cell = [
        F.col("d.doc_id").alias("doc_id"),
        F.coalesce(F.col("segment_id"), F.lit(-(2**31))).alias("segment"),
        F.coalesce(F.col("d.tf"), F.lit(0)).alias("tf"),
    ]
    element = token_entries.schema["docs"].dataType.elementType
    newest = Newest(token_entries.schema["segment_id"].dataType, element["tf"].dataType)

    heavy_counts = (
        entries.join(F.broadcast(heavy), keys)
        .select("term", "segment_id", opened)
        .select("term", *cell)
        .where("doc_id IS NOT NULL")
        .select("term", "doc_id", F.col("segment").cast("bigint"), F.col("tf").cast("bigint"))
        .mapInArrow(_combine(cells), "term bigint, part bigint, docs array<bigint>, segments array<bigint>, tfs array<bigint>")
        .repartition("term", "part")
        .mapInArrow(_count(cells), "term bigint, total_tf bigint, n_docs bigint")
        .groupBy("term")
        .agg(F.sum("total_tf").alias("total_tf"), F.sum("n_docs").alias("n_docs"))
        .join(F.broadcast(heavy), "term")
        .select(*keys, "total_tf", "n_docs")
    )
    light_counts = (
        entries.join(F.broadcast(heavy), keys, "left_anti")
        .repartition(*keys)
        .select(*keys, "segment_id", opened)
        .select(*keys, *cell)
        .where("doc_id IS NOT NULL")
        .groupBy(*keys, "doc_id")
        .agg(newest.value(F.max(newest.key(F.col("segment"), F.col("tf")))).cast("bigint").alias("tf"))
        .groupBy(*keys)
        .agg(F.sum("tf").alias("total_tf"), F.count("*").alias("n_docs"))
    )
    return light_counts.unionByName(heavy_counts)


def field_records(token_entries: DataFrame) -> DataFrame:
    """``(field_id, field_docs)``: the distinct records that the terms of a field list.  64 neighbouring ids are bits of one
    number, which each task merges before the exchange: dense ids travel as an eighth of a byte or less."""
    listed = entries_of(token_entries).select("field_id", F.explode("docs.doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(doc_id & 63 AS INT))")
    words = listed.groupBy("field_id", F.shiftright(F.col("doc_id").cast("bigint"), 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("field_id").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("field_docs"))


def term_marks(
    token_entries: DataFrame,
    rare_docs: int = RARE_DOCS,
    common_share: float = COMMON_SHARE,
    heavy_parts: int | None = None,
) -> DataFrame:
    """:func:`term_counts` with ``field_docs``, the distinct records that the terms of the field list altogether, and
    ``mark``: ``rare`` (in at most ``rare_docs`` records), ``common`` (in more than ``common_share`` of ``field_docs``)
    or null; a term that is both is ``rare``."""
    per_field = field_records(token_entries)
    counts = term_counts(token_entries, heavy_parts).join(small_side(per_field, FIELDS), "field_id")
    part = Fraction(str(common_share))
    common = F.col("n_docs") * part.denominator > F.col("field_docs") * part.numerator
    mark = F.when(F.col("n_docs") <= rare_docs, "rare").when(common, "common")
    return counts.select("field_id", "token", "total_tf", "n_docs", "field_docs", mark.alias("mark"))
