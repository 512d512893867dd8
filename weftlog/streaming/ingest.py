"""A streaming sink: each micro-batch is one import, named by query and epoch, so a replayed one is recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from weftlog.operators.writer import IMMEDIATE, ImportBatch, TableWriter


class IngestError(RuntimeError):
    """An import that neither went in nor was there before; the stream stops and can be restarted."""


def table_sink(stream: DataFrame, writer: TableWriter, name: str, order: tuple[str, ...] = ()) -> DataStreamWriter:
    """A writeStream that appends to the table exactly once; set its checkpoint and trigger, then start it."""

    def write(rows: DataFrame, epoch: int) -> None:
        if rows.isEmpty():
            return
        done = writer.import_batch(ImportBatch((f"{name}-{epoch}",), (rows,), IMMEDIATE, order))
        if done.code not in ("Committed", "AlreadyCommitted"):
            raise IngestError(f"{name}, epoch {epoch}: {done.code}")

    return stream.writeStream.foreachBatch(write).queryName(name)
