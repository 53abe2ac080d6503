"""Continuous ingest: each micro-batch of JSON documents is one commit of an index.

The number of the batch is saved by the commit that makes its documents searchable, so a batch that Spark repeats after
a failure is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.engine import Engine


def json_lines(engine: Engine, folder: str, max_files: int = 1_000) -> DataFrame:
    """Streaming rows ``(json)`` of the text files that arrive in a folder, one document a line."""
    lines = engine.spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return lines.withColumnRenamed("value", "json")


def stream_documents(
    engine: Engine,
    name: str,
    documents: DataFrame,
    checkpoint: str,
    stream: str = "stream",
    on_error: str = "skip",
    rejects: str | None = None,
    flush_every: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Starts a query that indexes ``documents``, streaming rows as :meth:`Engine.index_docs` takes them; ``trigger`` as in
    ``DataStreamWriter.trigger`` (``availableNow=True`` by default).  With ``flush_every`` n, each n-th batch ends in a flush.

    With ``skip`` rejected documents go, with the error that each would have been told, into a folder for their batch below
    ``rejects``, before the batch is committed; with ``raise`` a batch with one fails, and the query ends.
    """
    if on_error == "skip" and not rejects:
        raise ValueError("name a folder for rejected documents, or let them end the stream with on_error='raise'")

    def take(batch: DataFrame, number: int) -> None:
        folder = f"{rejects}/{stream}/batch={number}" if rejects else None
        engine.index_docs(name, batch, on_error, (stream, number), folder)
        if flush_every and (number + 1) % flush_every == 0:
            engine.store.flush(name, engine.compact_at)

    writer = documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
