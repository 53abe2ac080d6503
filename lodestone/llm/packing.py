"""Filling containers of fixed capacity with texts measured in tokens.

Harmonic packing: an item of size s belongs to class j = capacity // s, so any j items of the class fit one container,
and a container is opened for j items of one class.  Each worker does this for its own items and never looks at those
of another.  What the opening leaves free is filled with the largest smaller items that fit (they would otherwise need
containers of their own); without this, half of a container with one item of class 1 could stay empty.

The work is done on the counts of the sizes, not on single items: once a pattern of sizes is found it is repeated as
often as the counts allow, so a block of a million items takes thousands of steps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokenizing import COPIES, PIECE_CHARS, VOCABULARY, encode_corpus

CAPACITY = 2_048
#: Items that one worker packs at once, a few dozen bytes each.  Of an item over the capacity only the rest counts here: its
#: full parts are written out as they come.
BLOCK = 1 << 20
#: Parts of long items that are written out at once.
SLICE = 1 << 16


def patterns(counts, capacity: int, backfill: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """Containers for ``counts[s]`` items of size s (1 to capacity): pairs of a number of containers and what each of
    them holds, as (size, number of items).  Every item is in exactly one container."""
    left = [int(x) for x in counts]
    below = [0] * (capacity + 1)  # the next smaller size that may have items; kept short by halving paths

    for s in range(1, capacity + 1):
        below[s] = s if left[s] else s - 1

    def find(s: int) -> int:
        while below[s] != s:
            below[s] = below[below[s]]
            s = below[s]
        return s

    out = []
    top = find(capacity)
    while top:
        kind, room, held = capacity // top, capacity, []
        wanted, lowest = kind, capacity // (kind + 1)
        s = top
        while wanted and s > lowest:  # open with items of this class only
            k = min(wanted, left[s])
            held.append((s, k))
            wanted, room, s = wanted - k, room - k * s, find(s - 1)
        s = find(min(room, held[-1][0] - 1)) if backfill else 0
        while s:
            k = min(room // s, left[s])
            held.append((s, k))
            room -= k * s
            s = find(min(room, s - 1))
        times = min(left[s] // k for s, k in held)
        for s, k in held:
            left[s] -= times * k
            if not left[s]:
                below[s] = s - 1
        out.append((times, held))
        top = find(top)
    return out


def pack_block(sizes, capacity: int, backfill: bool = True):
    """Numpy arrays ``(container, start)`` for items of 1 to ``capacity`` units: the container's number from 0 and the
    units before the item in it.  Equal sizes are taken in the order given."""
    import numpy as np

    sizes = np.asarray(sizes, dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    counts = np.bincount(sizes, minlength=capacity + 1)
    cursor = np.concatenate([[0], np.cumsum(counts)[:-1]])
    container, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    number = 0
    for times, held in patterns(counts, capacity, backfill):
        offset = 0
        for s, k in held:
            items = order[cursor[s] : cursor[s] + times * k]
            cursor[s] += times * k
            container[items] = number + np.repeat(np.arange(times), k)
            start[items] = offset + s * np.tile(np.arange(k), times)
            offset += s * k
        number += times
    return container, start


def _packer(capacity: int, block: int, backfill: bool, piece: int = SLICE):
    def batch(ids, part, token_from, size, container, start):
        import numpy as np
        import pyarrow as pa

        none = container < 0
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(part.astype(np.int32)), pa.array(token_from), pa.array(size.astype(np.int32)),
             pa.array(container, mask=none), pa.array(start.astype(np.int32), mask=none)],
            names=["id", "part", "token_from", "n_tokens", "container_id", "start"],
        )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base, held, n = TaskContext.get().partitionId() << 40, [], 0

        def pack():
            """The rests of the held items; further containers are numbered from the last one on."""
            ids, parts, sizes = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
            some = sizes > 0
            container, start = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
            container[some], start[some] = pack_block(sizes[some], capacity, backfill)
            used = int(container.max()) + 1 if len(sizes) else 0
            return batch(ids, parts, parts * capacity, sizes, np.where(some, base + container, -1), start), used

        for rows in batches:
            copies, lengths = rows.column(2).to_numpy(), rows.column(1).to_numpy()
            full = lengths // capacity
            # Full parts: a container each, whatever the other items are.
            ends = np.cumsum(full * copies)
            total = int(ends[-1]) if len(ends) else 0
            for low in range(0, total, piece):
                at = np.arange(low, min(total, low + piece))
                row = np.searchsorted(ends, at, side="right")
                part = (at - (ends[row] - full[row] * copies[row])) % full[row]
                size = np.full(len(at), capacity)
                yield batch(rows.column(0).take(pa.array(row)), part, part * capacity, size, base + at - low, np.zeros(len(at)))
                base += len(at)
            rest = lengths - full * capacity
            keep = np.flatnonzero((rest > 0) | (full == 0))
            ends = np.cumsum(copies[keep])
            for low in range(0, int(ends[-1]) if len(ends) else 0, block):
                own = keep[np.searchsorted(ends, np.arange(low, min(int(ends[-1]), low + block)), side="right")]
                held.append((rows.column(0).take(pa.array(own)), full[own], rest[own]))
                n += len(own)
                if n >= block:
                    out, used = pack()
                    base, held, n = base + used, [], 0
                    yield out
        if n:
            yield pack()[0]

    return run


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, backfill: bool = True) -> DataFrame:
    """Packs the rows of ``sizes(id, n_tokens)``.

    One row per item: ``id``, ``part`` (0 unless the item is longer than the capacity), ``token_from`` and ``n_tokens``
    (what of the item the part holds), ``container_id``, ``start`` (tokens before it in the container).  Only items over
    the capacity are split, into full containers and one rest.  Items of no size (also null) take no room: one row with
    null ``container_id`` and ``start``.  Repeated rows are packed as often as they occur.  The result is the same when
    a task is repeated: rows are ordered by a hash before they are taken in blocks.
    """
    if capacity < 1 or block < 1:
        raise ValueError("capacity and block must be 1 or more")
    kind = sizes.schema["id"].dataType.simpleString()
    rows = sizes.select("id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    # Equal rows travel as a number of copies, in runs, so that no worker gets all rows of one id.
    counted = rows.groupBy("id", "n_tokens").agg(F.count("*").alias("copies"))
    runs = counted.select(
        "id", "n_tokens", "copies", F.expr(f"explode(sequence(0, (copies - 1) div {COPIES}))").alias("run")
    ).select("id", "n_tokens", "run", F.expr(f"least({COPIES}, copies - {COPIES} * run)").alias("copies"))
    return (
        runs.withColumn("at", F.xxhash64("id", "n_tokens", "run"))
        .repartition("at")
        .sortWithinPartitions("at", "id", "n_tokens", "run")
        .select("id", "n_tokens", "copies")
        .mapInArrow(
            _packer(capacity, block, backfill),
            f"id {kind}, part int, token_from bigint, n_tokens int, container_id bigint, start int",
        )
    )


def pack_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    piece_chars: int = PIECE_CHARS,
    block: int = BLOCK,
    backfill: bool = True,
) -> DataFrame:
    """Containers for every text of ``documents``, measured in tokens of ``vocabulary``; see :func:`pack_sizes`."""
    counted = encode_corpus(documents, id_column, text_column, vocabulary, piece_chars, counts_only=True)
    sizes = counted.select(F.col(id_column).alias("id"), "n_tokens")
    return pack_sizes(sizes, capacity, block, backfill).withColumnRenamed("id", id_column)
