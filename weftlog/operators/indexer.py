"""Indexing: log entries become one set of data files, invisible until the state is swapped."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftlog.operators.objects import APPLIED
from weftlog.operators.protocol import INDEX_ENTRIES, Batch, DataFile, Entry, Manifest, TableFiles, encode_index
from weftlog.operators.snapshot import Snapshot, SnapshotSource

#: Rows of one data file at most; an index pass with more writes several.
FILE_ROWS = 10_000_000


class Indexer:
    def __init__(self, spark: SparkSession, table: TableFiles, attempts: int = 4, file_rows: int = FILE_ROWS):
        self.spark, self.table, self.attempts, self.file_rows = spark, table, attempts, file_rows

    def _entries(self, after: int) -> list[Entry]:
        out: list[Entry] = []
        while len(out) < INDEX_ENTRIES and (entry := self.table.entry(after + len(out) + 1)) is not None:
            out.append(entry)
        return out

    def index(self) -> str:
        """Indexed, NothingToDo, RetryableConflict or InvalidState. Takes durable entries, published or not, up to the first gap."""
        for _ in range(self.attempts):
            found = self.table.current()
            if not found:
                return "InvalidState"
            state, token = found
            manifest, batches = self.table.manifest(state)
            entries = self._entries(state.indexed_seq)
            if not entries:
                return "NothingToDo"
            end = entries[-1].seq
            rows = [e for e in entries if e.kind == "Append"]
            files, keys = manifest.files, manifest.batch_index
            if rows:
                files = (*files, self._write(state, rows))
                known = {b.batch_id: b for b in batches} | {i: Batch(i, e.seq, e.operation_id, e.digest) for e in rows for i in e.batch_ids}
                fresh = [known[i] for e in rows for i in e.batch_ids]
                key = f"dedup/{uuid.uuid4().hex}"
                self.table.objects.create_if_absent(key, encode_index(list({b.batch_id: b for b in fresh}.values())))
                keys = (*keys, key)
            name = f"manifest/{uuid.uuid4().hex}"
            self.table.objects.create_if_absent(name, Manifest(state.table_id, end, manifest.schema, files, keys).encode())
            after = state.then(manifest=name, indexed_seq=end, published_seq=max(state.published_seq, end))
            if self.table.swap(state, token, after) == APPLIED:
                return "Indexed"
        return "RetryableConflict"

    def _write(self, state, entries: list[Entry]) -> DataFile:
        source = SnapshotSource(self.spark, self.table, Snapshot(state, (), tuple(entries), 0, False))
        count = sum(e.rows for e in entries)
        order = ["_seq", "_chunk", "_row"]
        rows = source.rows().drop("_src").select(*source.schema.names, F.col("_seq"), F.col("_chunk"), F.col("_row"))
        parts = -(-count // self.file_rows)
        rows = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, *order)
        path = self.table.files.url(f"data/{uuid.uuid4().hex}")
        rows.sortWithinPartitions(*order).write.parquet(path)
        return DataFile(tuple(sorted(self.spark.read.parquet(path).inputFiles())), min(e.seq for e in entries), max(e.seq for e in entries), count)
