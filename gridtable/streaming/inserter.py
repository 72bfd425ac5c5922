"""Buffered inserts, and a sink for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gridtable.sources.writer import Writer, rows_of


@dataclass(frozen=True)
class StreamConfig:
    """buffer_rows: rows after which a buffer is flushed."""

    buffer_rows: int = 10_000


class StreamInserter:
    """Collects batches and inserts them together; as a context manager it flushes at the end."""

    def __init__(self, writer: Writer, config: StreamConfig | None = None, committed: Callable[[], None] = lambda: None):
        self._writer, self._config, self._committed = writer, config or StreamConfig(), committed
        self._buffer: list[DataFrame] = []
        self.buffered_rows, self.total_flushed_rows, self.flush_count = 0, 0, 0

    def write(self, batch: object) -> int | None:
        """Take a batch; the transaction if it filled the buffer, else None."""
        rows = rows_of(self._writer.spark, batch)
        n = batch.num_rows if hasattr(batch, "num_rows") else rows.count()  # Arrow data is counted
        if n:
            self._buffer.append(rows)
            self.buffered_rows += n
        return self.flush() if self.buffered_rows >= self._config.buffer_rows else None

    def flush(self) -> int | None:
        """Insert what is buffered; None if that is nothing."""
        if not self._buffer:
            return None
        txn = self._writer.insert(reduce(DataFrame.unionByName, self._buffer))
        self.total_flushed_rows += self.buffered_rows
        self.flush_count += 1
        self._buffer, self.buffered_rows = [], 0
        self._committed()
        return txn

    def close(self) -> int | None:
        return self.flush()

    def __enter__(self) -> StreamInserter:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.close()


def sink(stream: DataFrame, writer: Writer, query_id: str, checkpoint: str, committed: Callable[[], object] = lambda: None) -> DataStreamWriter:
    """A stream writer that inserts each micro-batch once: the batch id is committed with the rows. ``committed`` runs after each."""

    def insert(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            writer.insert(batch, batch=(query_id, batch_id))
            committed()

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
