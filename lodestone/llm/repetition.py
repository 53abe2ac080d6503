"""How much of a text repeats what the same text said before.

For each of several n-gram lengths, the letters of the text (category L, after lower-casing) are hashed in all windows
of that length by a rolling polynomial in numpy.  Windows whose hash occurred earlier in the text are compared with
their first occurrence letter by letter, so a chance collision changes nothing.  A letter counts as repeated if it
lies in such a window; occurrences may overlap, and the first does not count.  Lines are treated likewise: a non-blank
line that equals an earlier one repeats all its characters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NGRAM_LENGTHS = (10, 20, 50)
#: Windows that are hashed and sorted at once; longer texts take several passes, each over a part of the range of hashes.
WINDOWS = 1 << 22


@lru_cache(maxsize=1)
def letter_codes():
    """For every code point a random odd 64-bit number, 0 for those that are no letters."""
    import numpy as np

    letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool)
    x = np.arange(len(letters), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.where(letters, x | np.uint64(1), np.uint64(0))


@lru_cache(maxsize=1)
def is_letter():
    """For every code point whether it counts."""
    return letter_codes() != 0


def window_hashes(codes, length: int):
    """Hash of codes[i : i + length] for each i, from hashes of windows of doubling length."""
    import numpy as np

    if len(codes) < length:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    full, full_len, power, out, out_len = codes, 1, base, None, 0
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out, out_len = full, full_len
            else:
                n = len(codes) - out_len - full_len + 1
                out = out[:n] * np.uint64(power) + full[out_len : out_len + n]
                out_len += full_len
        rest >>= 1
        if rest:
            n = len(codes) - 2 * full_len + 1
            full = full[:n] * np.uint64(power) + full[full_len : full_len + n]
            full_len, power = 2 * full_len, power * power % 2**64
    return out


def _hashes_of_part(letters, length: int, windows: int, part: int, parts: int):
    """Starts and hashes of the windows whose hash falls into a part of its range, hashed a piece of the text at a time."""
    import numpy as np

    table, at, hashes = letter_codes(), [], []
    for start in range(0, len(letters) - length + 1, windows):
        own = window_hashes(table[letters[start : start + windows + length - 1]], length)
        places = np.flatnonzero(own % np.uint64(parts) == part) if parts > 1 else np.arange(len(own))
        at.append(places + start)
        hashes.append(own[places] if parts > 1 else own)
    return (np.concatenate(at), np.concatenate(hashes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def repeated_windows(letters, length: int, windows: int = WINDOWS):
    """Sorted starts of the windows that equal a window started earlier."""
    import numpy as np

    found = []
    parts = max(1, -(-(len(letters) - length + 1) // windows))
    for part in range(parts):
        at, own = _hashes_of_part(letters, length, windows, part, parts)
        if len(at) < 2:
            continue
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            continue
        head = np.concatenate([[True], ~same])
        first = at[order[np.flatnonzero(head)[np.cumsum(head) - 1]]]
        later, first = at[order[~head]], first[~head]
        equal = np.ones(len(later), bool)
        for i in range(length):
            equal &= letters[later + i] == letters[first + i]
        found.append(later[equal])
        if not equal.all():  # two different windows have one hash: settle these by their content
            seen = {letters[i : i + length].tobytes() for i in np.unique(first[~equal])}
            for i in np.sort(later[~equal]):
                key = letters[i : i + length].tobytes()
                if key in seen:
                    found.append(np.array([i]))
                seen.add(key)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def covered(starts, length: int) -> int:
    """Letters inside windows of ``length`` at these sorted starts."""
    import numpy as np

    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts), length).sum()) + length


def measure(text: str, lengths: tuple[int, ...], windows: int = WINDOWS) -> tuple[int, list[int]]:
    """Letters of a text, and those that are repeated by each n-gram length."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = points[is_letter()[points]]
    return len(letters), [covered(repeated_windows(letters, n, windows), n) for n in lengths]


def repeated_lines(text: str) -> tuple[int, int]:
    """Characters of non-blank lines, without white space at the ends, and those in lines that occurred before."""
    seen: set[str] = set()
    total = again = 0
    for line in text.splitlines():
        if line := line.strip():
            total += len(line)
            again += len(line) if line in seen else 0
            seen.add(line)
    return total, again


def _measurer(lengths: tuple[int, ...], windows: int, lines: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                letters, repeats = measure(text or "", lengths, windows)
                rows.append([letters, *repeats, *(repeated_lines(text or "") if lines else (0, 0))])
            table = np.array(rows, dtype=np.int64).reshape(len(rows), len(lengths) + 3)
            columns = [pa.array(table[:, i]) for i in range(table.shape[1])]
            names = ["id", "n_letters", *(f"n{n}" for n in lengths), "line_chars", "line_repeats"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def repetition(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    ngram_lengths: tuple[int, ...] = NGRAM_LENGTHS,
    windows: int = WINDOWS,
    lines: bool = True,
) -> DataFrame:
    """One row for every row of ``documents``: the id, ``n_letters``, for each n-gram length n the counts
    ``repeated_n`` and shares ``share_n`` of letters inside repeated windows, and with ``lines`` ``share_lines`` of
    characters in repeated lines.

    Shares are 0 for null and empty texts and those shorter than n.  Ids may be null or repeated; other columns are not
    read.  Whole texts are measured; beside a few copies of the text itself, memory is bounded by ``windows``.
    """
    lengths = tuple(dict.fromkeys(int(n) for n in ngram_lengths))
    if not lengths or min(lengths) < 1:
        raise ValueError("n-gram lengths must be 1 or more")
    kind = documents.schema[id_column].dataType.simpleString()
    schema = ", ".join(
        [f"id {kind}", "n_letters bigint", *(f"n{n} bigint" for n in lengths), "line_chars bigint, line_repeats bigint"]
    )
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(_measurer(lengths, windows, lines), schema)

    def share(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    columns = [F.col("id").alias(id_column), F.col("n_letters")]
    for n in lengths:
        columns += [F.col(f"n{n}").alias(f"repeated_{n}"), share(f"n{n}", "n_letters").alias(f"share_{n}")]
    if lines:
        columns.append(share("line_repeats", "line_chars").alias("share_lines"))
    return out.select(*columns)
