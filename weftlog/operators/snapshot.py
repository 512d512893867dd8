"""Snapshots: an immutable set of files as a lazy frame. Data files come first, in manifest order, then log entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from weftlog.operators.protocol import DataFile, Entry, ProtocolError, State, TableFiles
from weftlog.sources.table import TableSource, looked_up
from weftlog.types import Schema

#: First, smallest and largest number of log places probed beyond what is published (fixed values).
PROBE, LEAST_PROBE, MOST_PROBE = 8, 1, 64
ORDER = ["_src", "_seq", "_chunk", "_row"]


@dataclass(frozen=True)
class Snapshot:
    state: State
    files: tuple[DataFile, ...]
    log: tuple[Entry, ...]
    probed: int
    full: bool  # every probed place held an entry

    @property
    def visible_through(self) -> int:
        return max(self.state.published_seq, self.log[-1].seq if self.log else 0)


def load(table: TableFiles, probe: int) -> Snapshot | None:
    """The snapshot of now: everything published, and up to `probe` further log places as far as they are filled."""
    for last in (False, True):
        found = table.current()
        if not found:
            return None
        state, _ = found
        manifest, _ = table.manifest(state)
        log: list[Entry] = []
        for seq in range(state.indexed_seq + 1, state.published_seq + 1):
            entry = table.entry(seq)
            if entry is None:
                break
            log.append(entry)
        else:
            break
        if last:
            raise ProtocolError("an entry up to the published position is missing")
    probed = 0
    while probed < probe:
        entry = table.entry(state.published_seq + probed + 1)
        if entry is None:
            break
        log.append(entry)
        probed += 1
    return Snapshot(state, manifest.files, tuple(e for e in log if e.kind == "Append"), probed, probe > 0 and probed == probe)


def _rows(spark: SparkSession, schema: Schema, paths: list[str], with_seq: bool) -> DataFrame:
    struct = schema.spark()
    if with_seq:
        struct = struct.add("_seq", LongType())
    return spark.read.schema(struct.add("_chunk", IntegerType()).add("_row", LongType())).parquet(*paths)


class SnapshotSource(TableSource):
    """Rows of a snapshot, which never change as the table goes on. A file that is gone is an error."""

    def __init__(self, spark: SparkSession, table: TableFiles, snapshot: Snapshot):
        self.spark, self.snapshot = spark, snapshot
        super().__init__(table.descriptor.schema, self.rows, ORDER, self._scan)

    def _scan(self) -> DataFrame:
        paths = [p for f in self.snapshot.files for p in f.paths] + [p for e in self.snapshot.log for p in e.payload]
        struct = self.schema.spark()
        return self.spark.read.schema(struct).parquet(*paths) if paths else self.spark.createDataFrame([], struct)

    def rows(self) -> DataFrame:
        schema = self.schema
        parts = []
        data = [p for f in self.snapshot.files for p in f.paths]
        if data:
            parts.append(_rows(self.spark, schema, data, True).withColumn("_src", F.lit(0)))
        if self.snapshot.log:
            # One read for all entries: the payload's folder tells the entry.
            paths = [p for e in self.snapshot.log for p in e.payload]
            places = {p.rsplit("/", 2)[1]: e.seq for e in self.snapshot.log for p in e.payload}
            folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
            rows = _rows(self.spark, schema, paths, False).withColumn("_folder", folder)
            parts.append(looked_up(rows, "_folder", list(places.items()), "_seq", "long").drop("_folder").withColumn("_src", F.lit(1)))
        if not parts:
            return self.spark.createDataFrame([], schema.spark()).withColumns({"_seq": F.lit(0).cast("long"), "_chunk": F.lit(0), "_row": F.lit(0).cast("long"), "_src": F.lit(0)})
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


class Table:
    """A table as readers see it; keeps the probe window, which follows how much unpublished log there is."""

    def __init__(self, spark: SparkSession, files: TableFiles):
        self.spark, self.files, self.window = spark, files, PROBE

    def snapshot(self, probe: bool = True) -> Snapshot | None:
        """probe: also what is durable and not yet published (not a point in time); without, published rows only."""
        found = load(self.files, self.window if probe else 0)
        if found is not None and probe:
            if found.full:
                self.window = min(MOST_PROBE, self.window * 2)
            elif found.probed * 4 < self.window:
                self.window = max(LEAST_PROBE, self.window // 2)
        return found

    def open(self, probe: bool = True) -> SnapshotSource | None:
        found = self.snapshot(probe)
        return SnapshotSource(self.spark, self.files, found) if found is not None else None
