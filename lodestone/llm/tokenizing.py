"""Encoding a corpus with a public byte-level BPE vocabulary.

A text of up to ``piece_chars`` characters is encoded where it is read.  A longer one is cut into pieces that are
encoded by different tasks, and the pieces' ids are put together by :func:`concatenate`: a balanced tree in which each
join re-encodes a window around the cut, growing it until the window's ids agree with both sides.  The ids are those
of encoding the whole text at once; no text is shortened.

Why agreement suffices.  A list of BPE tokens is the encoding of its bytes exactly if every two neighbours, encoded
together, come out as these two tokens.  Inside either side this already holds, inside the window too, and where the
window shares tokens with a side there is no pair that was not checked.  The splitting pattern that runs before the
merges looks forward only, and starting inside a run of one class of characters does not move the end of that run; only
a contraction (apostrophe and at most two letters) can be mistaken at a cut, hence agreement has to cover more than
that (``AGREE_TOKENS`` and ``AGREE_BYTES``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary on every executor; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 16_384
AGREE_TOKENS, AGREE_BYTES = 2, 8
#: Repeated rows are written out in runs of this length.
COPIES = 65_536


class ByteBpe:
    """The vocabulary; strings that look like special tokens are plain text."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self._encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str):
        """Ids of a text as a numpy array."""
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def text_of(self, ids) -> str | None:
        """The text of some ids; None if they do not begin and end between characters."""
        try:
            return b"".join(self.token_bytes[int(i)] for i in ids).decode("utf-8")
        except UnicodeDecodeError:
            return None

    def join(self, left, right, window: int = 8):
        """Ids of the text that two neighbouring pieces make up, from the ids of the pieces."""
        import numpy as np

        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            # The window has to begin and end between characters; else move its ends out by single tokens.
            text = self.text_of(left[a:].tolist() + right[:b].tolist())
            while text is None and (a > 0 or b < len(right)):
                a, b = max(0, a - 1), min(len(right), b + 1)
                text = self.text_of(left[a:].tolist() + right[:b].tolist())
            middle = self.encode(text)
            if (a == 0 or self._agree(middle, left[a:])) and (
                b == len(right) or self._agree(middle[::-1], right[:b][::-1])
            ):
                return np.concatenate([left[:a], middle, right[b:]])
            window *= 2

    def _agree(self, middle, side) -> bool:
        tokens = size = 0
        for x, y in zip(middle.tolist(), side.tolist()):
            if x != y:
                return False
            tokens, size = tokens + 1, size + len(self.token_bytes[x])
            if tokens >= AGREE_TOKENS and size >= AGREE_BYTES:
                return True
        return False

    def concatenate(self, parts: list):
        """Joins the ids of consecutive pieces pairwise, in rounds."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


@lru_cache(maxsize=2)
def load(vocabulary: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(vocabulary)


def _id_lists(arrays: list):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(arrays) + 1, dtype=np.int64)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    if offsets[-1] > 2**31 - 1:
        raise ValueError("too many ids for one batch; lower spark.sql.execution.arrow.maxBytesPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _encoder(vocabulary: str, counts_only: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe, none = load(vocabulary), np.zeros(0, dtype=np.uint32)
        for batch in batches:
            ids = [bpe.encode(x) if x else none for x in batch.column(batch.num_columns - 1).to_pylist()]
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            out = pa.array([len(x) for x in ids], pa.int64()) if counts_only else _id_lists(ids)
            yield pa.RecordBatch.from_arrays([*keys, out], names=[*batch.schema.names[:-1], "ids"])

    return run


def _joiner(vocabulary: str, counts_only: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = load(vocabulary)
        for batch in batches:
            ids = []
            for pieces in batch.column(2):
                order = np.argsort(pieces.values.field("pos").to_numpy())
                lists = pieces.values.field("ids")
                ids.append(bpe.concatenate([lists[int(i)].values.to_numpy().astype(np.uint32) for i in order]))
            out = pa.array([len(x) for x in ids], pa.int64()) if counts_only else _id_lists(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["id", "copies", "ids"])

    return run


def encode_corpus(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    piece_chars: int = PIECE_CHARS,
    counts_only: bool = False,
) -> DataFrame:
    """``(id_column, ids array<int>)``, one row for every row of ``documents``.

    Null and empty texts give an empty list; a null id stays null; repeated rows give repeated results; other columns,
    whatever their names, are not read.  With ``counts_only`` the second column is ``n_tokens bigint`` instead and the
    ids do not leave the workers, except those of texts longer than ``piece_chars``.
    """
    if piece_chars < 16:
        raise ValueError("piece_chars must be 16 or more")
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = "bigint" if counts_only else "array<int>"
    whole = rows.where(F.col("text").isNull() | (F.length("text") <= piece_chars)).mapInArrow(
        _encoder(vocabulary, counts_only), f"id {kind}, ids {found}"
    )
    # Repeated rows are counted where they are read, so that no task gets all copies.  Pieces of one text are told from
    # those of another by a digest of the text, which is the same in a repeated attempt.
    pieces = (
        rows.where(F.length("text") > piece_chars)
        .groupBy("id", F.md5(F.col("text").cast("binary")).alias("digest"))
        .agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
        .select("id", "digest", "copies", F.expr(f"regexp_extract_all(text, '(?s).{{1,{piece_chars}}}', 0)").alias("parts"))
        .select("id", "digest", "copies", F.posexplode("parts").alias("pos", "piece"))
        .repartition("id", "digest", "pos")
        .mapInArrow(
            _encoder(vocabulary, False), f"id {kind}, digest string, copies bigint, pos int, ids array<int>"
        )
    )
    joined = (
        pieces.groupBy("id", "digest", "copies")
        .agg(F.collect_list(F.struct("pos", "ids")).alias("pieces"))
        .select("id", "copies", "pieces")
        .mapInArrow(_joiner(vocabulary, counts_only), f"id {kind}, copies bigint, ids {found}")
        .select("id", "ids", "copies", F.expr(f"explode(sequence(0, (copies - 1) div {COPIES}))").alias("k"))
        .select("id", "ids", F.expr(f"explode(sequence(1, least({COPIES}, copies - {COPIES} * k)))").alias("k"))
        .select("id", "ids")
    )
    out = whole.unionByName(joined)
    name = "n_tokens" if counts_only else "ids"
    return out.select(F.col("id").alias(id_column), F.col("ids").alias(name))
