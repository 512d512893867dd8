"""Table sources: a schema and a lazy scan by field indices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftlog.functions.rowcodec import aliased, decode_frame
from weftlog.types import Schema

BATCH_ROWS = 1024
#: Most (path, number) pairs that are broadcast, some 20 MB; more are joined by shuffles.
BROADCAST_PAIRS = 100_000
#: Bytes of values that a task writes; what has more is written by more tasks than asked for.
PART_BYTES = 64 << 20


class TableSource:
    """A schema and a function that gives its rows, with the columns `order` that put them in order; `plain` gives them without, for scans."""

    def __init__(self, schema: Schema, rows: Callable[[], DataFrame], order: list[str], plain: Callable[[], DataFrame] | None = None):
        self.schema, self._rows, self.order, self._plain = schema, rows, order, plain or rows

    def scan(self, projection: list[int] | None = None) -> DataFrame:
        """The columns at these indices, in this order; lazy, so only they are read. IndexError for a bad index; an empty list keeps the rows."""
        return self._plain().select(*aliased(self.schema, self.schema.fitted(projection)))

    def ordered(self, projection: list[int] | None = None) -> DataFrame:
        """The same, sorted as the source orders its rows."""
        wanted = aliased(self.schema, self.schema.fitted(projection))
        return self._rows().orderBy(*self.order).select(*wanted)

    def collect_projected(self, projection: list[int] | None = None) -> list[tuple]:
        """All rows on the driver, in the source's order: for results known to be small."""
        return [tuple(r) for r in self.ordered(projection).collect()]

    def batches(self, projection: list[int] | None = None, batch_rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
        """Ordered batches of at most batch_rows rows (less than 1 is 1), pulled partition by partition."""
        df, size, held = self.ordered(projection), max(1, batch_rows), []
        types = to_arrow_schema(df.schema)
        for row in df.toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield _batch(types, held)
                held = []
        if held:
            yield _batch(types, held)


def _batch(types: pa.Schema, rows: list) -> pa.RecordBatch:
    """Rows as columns of the schema's types, whatever values they hold."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], names=types.names)


class ParquetSource(TableSource):
    """An explicit list of Parquet files, in list order; absent files are skipped (or an error where `required`)."""

    def __init__(self, spark: SparkSession, schema: Schema, files: list[str], required: bool = False):
        self.spark = spark
        found, absent = [], []
        for f in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            (found if fs.exists(path) else absent).append((f, str(fs.makeQualified(path).toUri().toString())))
        if required and absent:
            raise FileNotFoundError(absent[0][0])
        self.files = [f for f, _ in found]
        self._places = [re.sub("^file:/+", "file:/", u) for _, u in found]
        super().__init__(schema, self._read, ["_file", "_row"], self._scan)

    def _scan(self) -> DataFrame:
        struct = self.schema.spark()
        return self.spark.read.schema(struct).parquet(*self.files) if self.files else self.spark.createDataFrame([], struct)

    def _read(self) -> DataFrame:
        if not self.files:
            return self.spark.createDataFrame([], self.schema.spark()).withColumns({"_file": F.lit(0), "_row": F.lit(0).cast("long")})
        rows = self.spark.read.schema(self.schema.spark()).parquet(*self.files)
        row = F.col("_metadata.row_index").alias("_row")
        if len(self._places) == 1:
            return rows.select("*", F.lit(0).alias("_file"), row)
        places = list({p: i for i, p in reversed(list(enumerate(self._places)))}.items())
        rows = rows.select("*", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("_path"), row)
        return looked_up(rows, "_path", places, "_file", "int").select(*self.schema.names, "_file", "_row")

    def read_range(self, first: int, count: int, projection: list[int] | None = None, file: int = 0) -> DataFrame:
        """Rows [first, first + count) of one file, clamped at its end; the row index is pushed to the Parquet reader."""
        wanted = aliased(self.schema, self.schema.fitted(projection))
        rows = self.spark.read.schema(self.schema.spark()).parquet(self.files[file])
        index = F.col("_metadata.row_index")
        return rows.where((index >= first) & (index < first + max(0, count))).select(*wanted)

    def row_count(self) -> int:
        """From the footers: no column is read."""
        return self.spark.read.schema(self.schema.spark()).parquet(*self.files).count() if self.files else 0

    def windows(self, batch_rows: int = BATCH_ROWS) -> DataFrame:
        """The batches a scan makes: (file, batch, rows). They never cross files."""
        size = max(1, batch_rows)
        rows = self._read().select(F.col("_file").cast("int").alias("file"), F.floor(F.col("_row") / size).cast("long").alias("batch"))
        return rows.groupBy("file", "batch").agg(F.count(F.lit(1)).alias("rows"))


class RowSource(TableSource):
    """Row blobs of a key-value frame (k, v), in key order; only projected fields are decoded."""

    def __init__(self, schema: Schema, kv: Callable[[], DataFrame]):
        self._kv = kv
        super().__init__(schema, lambda: decode_frame(kv(), schema, None, ("k",)), ["k"])

    def scan(self, projection: list[int] | None = None) -> DataFrame:
        return decode_frame(self._kv(), self.schema, self.schema.fitted(projection))

    def ordered(self, projection: list[int] | None = None) -> DataFrame:
        wanted = self.schema.fitted(projection)
        return decode_frame(self._kv(), self.schema, wanted, ("k",)).orderBy("k").drop("k")


def looked_up(rows: DataFrame, key: str, pairs: list[tuple[str, int]], name: str, kind: str) -> DataFrame:
    """rows with the number that pairs give for their key (an error where they give none); few enough pairs are broadcast."""
    table = rows.sparkSession.createDataFrame(pairs, f"`{key}` string, `{name}` {kind}")
    joined = rows.join(F.broadcast(table) if len(pairs) <= BROADCAST_PAIRS else table, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.concat(F.lit("unlisted file "), F.col(key))).cast(kind)))


def write_files(df: DataFrame, folder: str, files: int = 1, compression: str = "none", order: list[str] | None = None) -> list[str]:
    """Write df as so many Parquet files in the order of `order`, more where one would have over PART_BYTES, and list them. compression: none, or zlib (deflate)."""
    codec = {"none": "none", "zlib": "gzip"}[compression]
    files = parts(df, files)
    if order and files > 1:
        df = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    elif order:
        df = df.coalesce(1).sortWithinPartitions(*order)
    else:
        df = df.coalesce(files)
    df.write.mode("overwrite").option("compression", codec).parquet(folder)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(n for n in names if n.endswith(".parquet"))


def parts(df: DataFrame, least: int = 1) -> int:
    """The number of equal parts, least or more, that have PART_BYTES of values at most; a pass over df adds up their sizes."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        value = F.col(f"`{f.name}`")
        fixed = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        size += F.lit(8) if fixed else F.coalesce(F.octet_length(value if isinstance(f.dataType, T.BinaryType) else value.cast("string")), F.lit(0))
    return max(least, -(-(df.agg(F.sum(size)).head()[0] or 0) // PART_BYTES))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in the given order: for frames known to be small."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
