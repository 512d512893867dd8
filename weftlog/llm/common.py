"""What the operators of this folder share: reading tables, shared storage, words and Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here has it: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches are cut at this many bytes, so that a worker holds few long texts at a time.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch handed to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """Tables written to the shared folder to cut lineage; drop() deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.base = f"{shared_dir(spark)}/weftlog-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the table that write() returned as df."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A table of up to this many narrow rows (ids and fingerprints) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def if_small(written: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most `most` of them."""
    return F.broadcast(written) if written.count() <= most else written


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets has one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings of a string column, nulls as empty."""
    return column.fill_null("").to_pylist() if column.null_count else column.to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


#: Odd multipliers of the word and shingle fingerprints (fixed values).
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), _M1)]), dtype=np.uint64)
    return _POWERS[:n]


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS_LOWER = _LETTERS[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words of many texts (A-Z lower-cased), in order, and the number of words of each text.

    raw, at: as text_buffers() gives them. A word never crosses texts.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = ~_BLANK[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < n]
    starts[edge] = inside[edge]
    ends = np.zeros(n, bool)
    ends[:-1] = inside[:-1] & ~inside[1:]
    ends[-1] = inside[-1]
    last = at[1:] - 1
    last = last[(last >= 0) & (last < n)]
    ends[last] |= inside[last]
    first, end = np.flatnonzero(starts), np.flatnonzero(ends)
    with np.errstate(over="ignore"):
        power = _powers(n)
        sums = np.cumsum(_LETTERS_LOWER[raw] * power, dtype=np.uint64)
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        # Divide by the power at the word's start, through its inverse.
        inverse = _inverse_powers(n)[first]
        value = (sums[end] - before) * inverse
        value = mix(value + (end - first + 1).astype(np.uint64) * _M1)
    counts = np.searchsorted(first, at[1:], "left") - np.searchsorted(first, at[:-1], "left")
    return value, counts


_INVERSES = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        unit = np.uint64(pow(int(_M1), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), unit)]), dtype=np.uint64)
    return _INVERSES[:n]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of a text's runs of `size` words; with fewer words the whole sequence is one; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    with np.errstate(over="ignore"):
        value = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            value = mix(value * _M1 + words[i : n - k + 1 + i])
    return np.unique(value)


def count_words(text):
    """The number of words of a text column (null: 0), inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
