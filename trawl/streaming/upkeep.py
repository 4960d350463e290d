"""Indexes kept up with an append-only or update stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trawl.sources.path_index import PathIndex, refresh_path_index
from trawl.sources.term_index import TermIndex, refresh_term_index


def keep_index(stream: DataFrame, index: TermIndex | PathIndex, checkpoint: str, order: str | None = None,
               **trigger) -> StreamingQuery:
    """Start indexing a stream of rows. ``trigger``: as for ``DataStreamWriter.trigger``.

    A batch that is replayed after a failure replaces the rows of its keys by the same rows. With
    ``order``, a key's newest version by that column stays, whatever batch it came in; without one, a
    later batch replaces an earlier one's rows. One stream at a time keeps an index.
    """
    refresh = refresh_term_index if isinstance(index, TermIndex) else refresh_path_index

    def add(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh(batch, index, order)

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
