"""Digests of ordered rows, computed in parts: each row's SHA-256 with its place, combined by exclusive or."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(columns: list[tuple[str, str]]) -> Column:
    """A row as one string, different for different rows: lengths before values (Java's shortest decimals tell all doubles apart, -0.0 too)."""
    parts = []
    for name, kind in columns:
        text = F.hex(F.col(f"`{name}`")) if kind == "binary" else F.col(f"`{name}`").cast("string")
        parts += [F.length(text).cast("string"), F.lit(":"), text, F.lit("|")]
    return F.concat(*parts) if parts else F.lit("")


def lanes(df: DataFrame, place: list[str], names: list[str]) -> list[Column]:
    """Aggregates that digest the rows of a group, each bound to its place."""
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat_ws("/", *[F.col(p).cast("string") for p in place], canonical([(n, kinds[n]) for n in names])), 256)
    return [F.bit_xor(F.conv(F.substring(row, 16 * i + 1, 16), 16, -10).cast("long")).alias(f"_d{i}") for i in range(4)]


def payload_digest(schema_version: int, batch_ids: list[str], chunks: list[tuple[int, int, tuple[int, ...]]]) -> str:
    """SHA-256 over the schema version, the ordered batch ids, and (chunk, rows, lanes) of each chunk."""
    return hashlib.sha256(json.dumps([schema_version, batch_ids, [[c, n, list(d)] for c, n, d in chunks]], separators=(",", ":")).encode()).hexdigest()
