"""The columnar interchange format DBC1: one page per column, a footer with their places, little-endian.

Layout (fixed values): "DBC1", the pages, the footer, its size as u64, "DBC1". The footer has the number of rows and of
columns (u64 each), then for each column encoding u8 (1 plain), compression u8 (1 none, 2 zlib) and u64 offset, stored
size, raw size and number of values. A plain page is the packed values, or for strings and blobs a u32 length and the
bytes of each. Names and types aren't stored; the caller's schema gives them.

As a Spark source: format "dbc1" with options schema (JSON of names and types), columns (comma-joined, pruned by the
caller, since a Python source isn't told which are used) and files; one partition per file, whose pages are read once,
front to back. As a sink: files of some FILE_BYTES for each partition, with option compression none or zlib.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftlog.functions.rowcodec import _ARROW
from weftlog.types import CODE, WIDTH, Schema, SchemaError

MAGIC = b"DBC1"
PLAIN = 1
#: Bytes of a page that are read, and inflated, at once.
BLOCK = 1 << 20
#: Bytes of rows in memory after which the sink begins another file.
FILE_BYTES = 64 << 20
_COLUMN = struct.Struct("<BBQQQQ")


class Compression:
    """Codecs by id; an unknown id or a wrong size is an error."""

    IDS = {"none": 1, "zlib": 2}

    @staticmethod
    def pack(name: str, raw: bytes) -> bytes:
        if name not in Compression.IDS:
            raise SchemaError(f"unknown compression {name}")
        return raw if name == "none" or not raw else zlib.compress(raw)

    @staticmethod
    def unpack(number: int, stored: bytes, size: int) -> bytes:
        if number not in Compression.IDS.values():
            raise SchemaError(f"unknown compression {number}")
        try:
            raw = stored if number == 1 or not size else zlib.decompress(stored)
        except zlib.error as e:
            raise SchemaError("corrupt page") from e
        if len(raw) != size:
            raise SchemaError("a page has another size than its footer says")
        return raw


def encode_page(kind: str, column: pa.Array) -> bytes:
    if column.null_count:
        raise SchemaError("null in a column")
    if WIDTH[kind]:
        return column.to_numpy(zero_copy_only=False).astype(CODE[kind]).tobytes()
    out = []
    for value in column.to_pylist():
        raw = value.encode() if isinstance(value, str) else value
        out += [struct.pack("<I", len(raw)), raw]
    return b"".join(out)


def decode_page(kind: str, raw: bytes, count: int) -> pa.Array:
    width = WIDTH[kind]
    if width:
        if len(raw) != width * count:
            raise SchemaError("a page ends early")
        values = np.frombuffer(raw, CODE[kind])
        return pa.array(values != 0 if kind == "Bool" else values, _ARROW[kind])
    out, at = [], 0
    for _ in range(count):
        if at + 4 > len(raw):
            raise SchemaError("a page ends early")
        (n,) = struct.unpack_from("<I", raw, at)
        if at + 4 + n > len(raw):
            raise SchemaError("a page ends early")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    if kind == "String":
        try:
            return pa.array([v.decode() for v in out], pa.string())
        except UnicodeDecodeError as e:
            raise SchemaError("bytes that are no UTF-8 in a String column; its type must be Blob") from e
    return pa.array(out, pa.binary())


def encode_file(schema: Schema, table: pa.Table, compression: str = "none") -> bytes:
    """A file of one row group with all rows."""
    return b"".join(_pieces(schema, table, compression))


def _pieces(schema: Schema, table: pa.Table, compression: str) -> Iterator[bytes]:
    """The same from front to back, a page at a time."""
    if len(table.columns) != len(schema.fields):
        raise SchemaError(f"{len(table.columns)} columns for {len(schema.fields)} fields")
    yield MAGIC
    meta, at = [], len(MAGIC)
    for field, column in zip(schema.fields, table.columns, strict=True):
        raw = encode_page(field.type, column.combine_chunks())
        stored = Compression.pack(compression, raw)
        meta.append(_COLUMN.pack(PLAIN, Compression.IDS[compression], at, len(stored), len(raw), table.num_rows))
        yield stored
        at += len(stored)
    footer = struct.pack("<QQ", table.num_rows, len(meta)) + b"".join(meta)
    yield footer + struct.pack("<Q", len(footer)) + MAGIC


class _Page:
    """A page from front to back. It is read and inflated a block at a time, once, and holds little more than the values asked for."""

    def __init__(self, kind: str, read_at, codec: int, offset: int, stored: int, size: int):
        self.kind, self._blocks, self._held, self._at = kind, _blocks(read_at, codec, offset, stored, size), bytearray(), 0

    def _has(self, n: int) -> bool:
        """Whether n more bytes follow; they are held then."""
        while len(self._held) - self._at < n:
            if (block := next(self._blocks, None)) is None:
                return False
            del self._held[: self._at]
            self._held += block
            self._at = 0
        return True

    def take(self, n: int) -> pa.Array:
        """The next n values."""
        width, length = WIDTH[self.kind], 0
        if width:
            length = n * width
        else:
            for _ in range(n):
                if not self._has(length + 4):
                    raise SchemaError("a page ends early")
                length += 4 + struct.unpack_from("<I", self._held, self._at + length)[0]
        if not self._has(length):
            raise SchemaError("a page ends early")
        raw = bytes(self._held[self._at : self._at + length])
        self._at += length
        return decode_page(self.kind, raw, n)

    def close(self) -> None:
        """Read on to the end, so that a page is checked whole."""
        for _ in self._blocks:
            pass


def _blocks(read_at, codec: int, offset: int, stored: int, size: int) -> Iterator[bytes]:
    """The raw bytes of a page, a block at a time, with the checks of Compression.unpack."""
    if codec not in Compression.IDS.values():
        raise SchemaError(f"unknown compression {codec}")
    inflate, left = zlib.decompressobj() if codec != 1 and size else None, size
    for at in range(offset, offset + stored, BLOCK):
        data = read_at(at, min(BLOCK, offset + stored - at))
        while True:
            try:
                raw = inflate.decompress(data, BLOCK) if inflate else data
            except zlib.error as e:
                raise SchemaError("corrupt page") from e
            if (left := left - len(raw)) < 0:
                raise SchemaError("a page has another size than its footer says")
            yield raw
            if not inflate or inflate.eof or len(raw) < BLOCK:
                break
            data = inflate.unconsumed_tail
        if inflate and inflate.eof:
            break
    if inflate and not inflate.eof:
        raise SchemaError("corrupt page")
    if left:
        raise SchemaError("a page has another size than its footer says")


class Columnar:
    """A file by its footer; pages are read when they are asked for. `read_at(offset, length)` gives byte ranges."""

    def __init__(self, schema: Schema, size: int, read_at):
        self.schema, self._read = schema, read_at
        if size < len(MAGIC) * 2 + 24 or read_at(size - 4, 4) != MAGIC:
            raise SchemaError("no DBC1 file")
        (length,) = struct.unpack("<Q", read_at(size - 12, 8))
        if length < 16 or length > size - 16:
            raise SchemaError("corrupt footer")
        footer = read_at(size - 12 - length, length)
        self.rows, columns = struct.unpack_from("<QQ", footer)
        if columns != len(schema.fields) or length != 16 + columns * _COLUMN.size:
            raise SchemaError("the footer has other columns than the schema")
        self.columns = [_COLUMN.unpack_from(footer, 16 + i * _COLUMN.size) for i in range(columns)]
        for encoding, _, offset, stored, _, _ in self.columns:
            if encoding != PLAIN or offset + stored > size:
                raise SchemaError("corrupt footer")

    def read_range(self, first: int, count: int, projection: list[int] | None = None) -> pa.RecordBatch | None:
        """Rows [first, first + count), clamped at the end; None beyond it. Uncompressed fixed-width columns read their bytes only."""
        wanted = self.schema.fitted(projection)
        n = min(count, self.rows - first) if first >= 0 else 0
        if n <= 0:
            return None
        arrays = []
        for i in wanted:
            kind = self.schema.fields[i].type
            _, codec, offset, stored, raw, values = self.columns[i]
            width = WIDTH[kind]
            if width and codec == 1:
                arrays.append(decode_page(kind, self._read(offset + first * width, n * width), n))
            else:
                arrays.append(decode_page(kind, Compression.unpack(codec, self._read(offset, stored), raw), values).slice(first, n))
        return _batch(arrays, n)

    def batches(self, batch_rows: int, projection: list[int] | None = None) -> Iterator[pa.RecordBatch]:
        """All rows in order, so many at a time; each page is decoded once, whatever their number."""
        pages = []
        for i in self.schema.fitted(projection):
            kind, (_, codec, offset, stored, raw, values) = self.schema.fields[i].type, self.columns[i]
            if values < self.rows or WIDTH[kind] and raw != WIDTH[kind] * values:
                raise SchemaError("a page ends early")
            pages.append(_Page(kind, self._read, codec, offset, stored, raw))
        for first in range(0, self.rows, batch_rows):
            n = min(batch_rows, self.rows - first)
            yield _batch([p.take(n) for p in pages], n)
        for p in pages:
            p.close()


def _batch(arrays: list[pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=[f"{k}" for k in range(len(arrays))]) if arrays else pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, schema: Schema, columns: list[str], files: list[str], batch_rows: int):
        self.schema, self.columns, self.files, self.batch_rows = schema, columns, files, max(1, batch_rows)

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no files
            return
        with pa.OSFile(partition.value, "rb") as f:
            file = Columnar(self.schema, f.size(), lambda offset, length: f.read_at(length, offset))
            for batch in file.batches(self.batch_rows, [self.schema.names.index(c) for c in self.columns]):
                yield pa.RecordBatch.from_arrays(batch.columns, names=self.columns)


class _Message(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: Schema, folder: str, compression: str):
        self.schema, self.folder, self.compression = schema, folder, compression

    def write(self, iterator):
        paths, held, size = [], [], 0
        for batch in iterator:
            if held and size + batch.nbytes > FILE_BYTES:
                paths.append(self._file(held))
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
        return _Message([*paths, self._file(held)] if held else paths)

    def _file(self, batches: list[pa.RecordBatch]) -> str:
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{uuid.uuid4().hex}.dbc1")
        with open(f"{path}.tmp", "xb") as f:
            f.writelines(_pieces(self.schema, pa.Table.from_batches(batches), self.compression))
        return path

    def commit(self, messages):
        """The files take their names when all tasks are done, so none of a task that was tried again stays."""
        import os

        os.makedirs(self.folder, exist_ok=True)
        for path in (p for m in messages if m for p in m.paths):
            os.replace(f"{path}.tmp", path)

    def abort(self, messages):
        import contextlib
        import os

        for path in (p for m in messages if m for p in m.paths):
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{path}.tmp")


class ColumnarFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbc1"

    def _schema(self) -> Schema:
        return Schema.from_json(json.loads(self.options["schema"]))

    def _columns(self) -> list[str]:
        return self.options["columns"].split(",") if self.options.get("columns") else self._schema().names

    def schema(self):
        whole = self._schema()
        return type(whole.spark())([whole.spark()[c] for c in self._columns()])

    def reader(self, schema):
        return _Reader(self._schema(), self._columns(), json.loads(self.options["files"]), int(self.options.get("batch_rows", 1024)))

    def writer(self, schema, overwrite):
        return _Writer(Schema.from_spark(schema), self.options["path"], self.options.get("compression", "none"))


def read_dbc1(spark: SparkSession, schema: Schema, files: list[str], projection: list[int] | None = None) -> DataFrame:
    """The projected columns of DBC1 files on a file system that all executors mount; absent files are skipped."""
    import os

    spark.dataSource.register(ColumnarFormat)
    names = [schema.fields[i].name for i in schema.fitted(projection)]
    once = list(dict.fromkeys(names)) or schema.names[:1]
    found = [f for f in files if os.path.exists(f)]
    rows = spark.read.format("dbc1").option("schema", json.dumps(schema.json())).option("columns", ",".join(once)).option("files", json.dumps(found)).load()
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n] = seen.get(n, -1) + 1
        out.append(rows[n].alias(f"{n}_{k}" if k else n))
    return rows.select(*out)


def write_dbc1(df: DataFrame, folder: str, compression: str = "none") -> None:
    """DBC1 files of some FILE_BYTES of rows for each partition of df, in a folder that the driver and all executors mount."""
    df.sparkSession.dataSource.register(ColumnarFormat)
    Schema.from_spark(df.schema)
    df.write.format("dbc1").mode("append").option("compression", compression).save(folder)
