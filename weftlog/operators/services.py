"""Tables by name: a catalog, routing of imports to the writer of a table, and queries that never touch a writer."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import SparkSession

from weftlog.operators.indexer import Indexer
from weftlog.operators.objects import store_at
from weftlog.operators.protocol import Descriptor, TableFiles
from weftlog.operators.snapshot import SnapshotSource, Table
from weftlog.operators.writer import ImportBatch, ImportResult, TableWriter
from weftlog.types import Schema


def open_files(spark: SparkSession, descriptor: Descriptor) -> TableFiles:
    return TableFiles(descriptor, store_at(spark, descriptor.metadata_root), store_at(spark, descriptor.file_root))


class Catalog:
    """Descriptors by (database, table)."""

    def __init__(self, root: str):
        self.root, self._tables = root.rstrip("/"), {}

    def create(self, spark: SparkSession, database: str, table: str, schema: Schema) -> Descriptor:
        base = f"{self.root}/tables/{database}/{table}"
        made = Descriptor(f"{database}/{table}", f"{base}/metadata", f"{base}/files", schema)
        open_files(spark, made).initialise()
        self._tables[database, table] = made
        return made

    def resolve(self, database: str, table: str) -> Descriptor | None:
        return self._tables.get((database, table))


class Router(Protocol):
    """Finds the writer service of a table (None: no writer is available)."""

    def route(self, table_id: str) -> WriterService | None: ...


class WriterService:
    """The writers of one process, one for each table."""

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self._writers = spark, catalog, {}

    def import_batch(self, descriptor: Descriptor, batch: ImportBatch) -> ImportResult:
        writer = self._writers.get(descriptor.table_id)
        if writer is None or not writer.started:
            writer = self._writers[descriptor.table_id] = TableWriter(self.spark, open_files(self.spark, descriptor))
            started = writer.start()
            if started.code != "Started":
                return started
        return writer.import_batch(batch)


class OneProcess:
    """Routes every table to one service."""

    def __init__(self, service: WriterService | None):
        self.service = service

    def route(self, table_id: str) -> WriterService | None:
        return self.service


class ImportService:
    def __init__(self, catalog: Catalog, router: Router):
        self.catalog, self.router = catalog, router

    def import_batch(self, database: str, table: str, batch: ImportBatch) -> ImportResult:
        descriptor = self.catalog.resolve(database, table)
        if descriptor is None:
            return ImportResult("TableNotFound")
        service = self.router.route(descriptor.table_id)
        return service.import_batch(descriptor, batch) if service else ImportResult("NoWriterAvailable")


class QueryService:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self._tables = spark, catalog, {}

    def table(self, database: str, name: str) -> Table | None:
        descriptor = self.catalog.resolve(database, name)
        if descriptor is None:
            return None
        if descriptor.table_id not in self._tables:
            self._tables[descriptor.table_id] = Table(self.spark, open_files(self.spark, descriptor))
        return self._tables[descriptor.table_id]

    def open(self, database: str, name: str, probe: bool = True) -> SnapshotSource | None:
        table = self.table(database, name)
        return table.open(probe) if table else None

    def view(self, database: str, name: str, as_name: str | None = None, probe: bool = False) -> None:
        """A snapshot as a temporary view, for SQL."""
        source = self.open(database, name, probe)
        if source is None:
            raise KeyError(f"{database}.{name}")
        source.scan().createOrReplaceTempView(as_name or name)

    def indexer(self, database: str, name: str) -> Indexer:
        return Indexer(self.spark, open_files(self.spark, self.catalog.resolve(database, name)))


def fresh_root(base: str) -> str:
    return f"{base.rstrip('/')}/weftlog-{uuid.uuid4().hex}"
