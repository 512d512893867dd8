"""Rows as blobs: the fields in schema order, fixed-width values as they are, others behind a 32-bit length; little-endian."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.types import CODE, SPARK, WIDTH, Schema, SchemaError

_FORMAT = {"Int32": "<i", "Int64": "<q", "Float": "<f", "Double": "<d", "Bool": "<B"}
_ARROW = {"Int32": pa.int32(), "Int64": pa.int64(), "Float": pa.float32(), "Double": pa.float64(), "Bool": pa.bool_(), "String": pa.string(), "Blob": pa.binary()}


def encode_row(schema: Schema, row: tuple) -> bytes:
    if len(row) != len(schema.fields):
        raise SchemaError(f"{len(row)} values for {len(schema.fields)} fields")
    out = []
    for field, value in zip(schema.fields, row, strict=True):
        if value is None:
            raise SchemaError(f"null in {field.name}")
        if WIDTH[field.type]:
            out.append(struct.pack(_FORMAT[field.type], value))
        else:
            raw = value.encode() if isinstance(value, str) else bytes(value)
            out += [struct.pack("<I", len(raw)), raw]
    return b"".join(out)


def decode_row(schema: Schema, blob: bytes, projection: list[int] | None = None) -> tuple:
    """The projected values; what follows the last field is ignored, a blob that ends early is a SchemaError."""
    wanted, values, at = schema.fitted(projection), {}, 0
    need = set(wanted)
    for i, field in enumerate(schema.fields):
        width = WIDTH[field.type]
        if width is None:
            if at + 4 > len(blob):
                raise SchemaError("row blob ends early")
            (width,) = struct.unpack_from("<I", blob, at)
            at += 4
        if at + width > len(blob):
            raise SchemaError("row blob ends early")
        if i in need:
            raw = blob[at : at + width]
            if field.type == "String":
                try:
                    values[i] = raw.decode()
                except UnicodeDecodeError as e:
                    raise SchemaError(f"{field.name} holds bytes that are no UTF-8; its type must be Blob") from e
            elif field.type == "Blob":
                values[i] = bytes(raw)
            else:
                (number,) = struct.unpack(_FORMAT[field.type], raw)
                values[i] = bool(number) if field.type == "Bool" else number
        at += width
    return tuple(values[i] for i in wanted)


def _blobs(schema: Schema, batch: pa.RecordBatch) -> pa.Array:
    """All rows of a batch at once: each column's bytes are laid into one buffer."""
    n = batch.num_rows
    parts = []  # (sizes, bytes back to back) in field order
    for field, column in zip(schema.fields, batch.columns, strict=True):
        if column.null_count:
            raise SchemaError(f"null in {field.name}")
        if field.type in CODE:
            raw = np.ascontiguousarray(column.to_numpy(zero_copy_only=False).astype(CODE[field.type]))
            parts.append((np.full(n, raw.itemsize, np.int64), raw.view(np.uint8).reshape(-1)))
            continue
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        size = np.diff(at)
        data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] and at[-1] > at[0] else np.zeros(0, np.uint8)
        parts += [(np.full(n, 4, np.int64), size.astype("<u4").view(np.uint8)), (size, data)]
    total = sum((s for s, _ in parts), np.zeros(n, np.int64))
    ends = np.cumsum(total)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    start = ends - total
    for size, data in parts:
        first = np.cumsum(size) - size
        out[np.repeat(start - first, size) + np.arange(len(data))] = data
        start = start + size
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def encode_frame(df: DataFrame, schema: Schema, key: Column | None = None) -> DataFrame:
    """df (the schema's columns) -> [k,] v: one blob for each row, with a key computed from its columns."""
    schema.check(df.select(*schema.names))
    n = len(schema.fields)

    def run(batches):
        for batch in batches:
            body = pa.RecordBatch.from_arrays(batch.columns[:n], names=schema.names)
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], _blobs(schema, body)], names=["k", "v"] if batch.num_columns > n else ["v"])

    rows = df.select(*schema.names, *([key.alias("k")] if key is not None else []))
    return rows.mapInArrow(run, "k binary, v binary" if key is not None else "v binary")


def _fields(schema: Schema, blobs: pa.Array, wanted: list[int]) -> list[pa.Array]:
    """The wanted fields of all blobs at once, with decode_row's checks; each field is gathered from the blobs' one buffer."""
    if blobs.null_count:
        raise SchemaError("null row blob")
    blobs, n = blobs.cast(pa.large_binary()), len(blobs)
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
    at, end, out = ends[:-1].copy(), ends[1:], {}

    def fixed(width: int) -> np.ndarray:
        if (at + width > end).any():
            raise SchemaError("row blob ends early")
        return data[at[:, None] + np.arange(width)]

    for i, field in enumerate(schema.fields):
        if field.type in CODE:
            raw = fixed(WIDTH[field.type])
            if i in wanted:
                numbers = raw.reshape(-1).view(_FORMAT[field.type])
                out[i] = pa.array(numbers != 0 if field.type == "Bool" else numbers, _ARROW[field.type])
            at += WIDTH[field.type]
            continue
        size = fixed(4).reshape(-1).view("<u4").astype(np.int64)
        at += 4
        if (at + size > end).any():
            raise SchemaError("row blob ends early")
        if i in wanted:
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            held = data[np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])]
            values = pa.Array.from_buffers(pa.large_string() if field.type == "String" else pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes())])
            try:
                values.validate(full=True)
            except pa.ArrowInvalid as e:
                raise SchemaError(f"{field.name} holds bytes that are no UTF-8; its type must be Blob") from e
            out[i] = values.cast(_ARROW[field.type])
        at += size
    return [out[i] for i in wanted]


def decode_frame(blobs: DataFrame, schema: Schema, projection: list[int] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A frame with column v -> the projected columns (decoded alone), after those named in carry."""
    wanted = schema.fitted(projection)
    once = list(dict.fromkeys(wanted))
    fields = [schema.fields[i] for i in once]
    kept = blobs.select(*carry, "v")
    types = ", ".join([f"`{c}` {dict(kept.dtypes)[c]}" for c in carry] + [f"`{f.name}` {SPARK[f.type].simpleString()}" for f in fields] + (["_none int"] if not fields and not carry else []))

    def run(batches):
        for batch in batches:
            columns = _fields(schema, batch.column("v"), once)
            if not fields and not carry:
                columns = [pa.array(np.zeros(batch.num_rows, np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], names=[*carry, *[f.name for f in fields]] if fields or carry else ["_none"])

    return kept.mapInArrow(run, types).select(*carry, *aliased(schema, wanted))


def aliased(schema: Schema, wanted: list[int]) -> list[Column]:
    """Columns of a projection; a column named again gets a number."""
    seen: dict[int, int] = {}
    out = []
    for i in wanted:
        name, k = schema.fields[i].name, seen.get(i, 0)
        seen[i] = k + 1
        out.append(F.col(f"`{name}`").alias(f"{name}_{k}" if k else name))
    return out
