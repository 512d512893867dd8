"""An ordered key-value table: unique keys of eight bytes, opaque values, first insert wins.

The table is a list of immutable segments: rows put, and keys removed. Each change writes one segment and commits the
list by compare-and-swap, so readers see whole changes only; nothing is rewritten but by compact().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions.keys import KEY_LENGTH
from weftlog.operators.objects import APPLIED, MetadataStore, store_at

#: Largest value (fixed value): a page of 16384 bytes without its header and one slot.
MOST_VALUE = 16384 - 12 - 8


class KeyValueTable:
    def __init__(self, spark: SparkSession, root: str):
        """Open the table in this folder; a new folder is an empty table."""
        self.spark, self.root = spark, root.rstrip("/")
        self.metadata = MetadataStore(store_at(spark, self.root))
        self._load()

    def _load(self) -> None:
        found = self.metadata.get("kv")
        self._segments, self._version = (json.loads(found[0]), found[1]) if found else ([], 0)

    def _commit(self, segments: list[dict]) -> None:
        data = json.dumps(segments).encode()
        done, version = self.metadata.compare_exchange("kv", self._version, data) if self._version else self.metadata.put_if_absent("kv", data)
        if done != APPLIED:
            raise RuntimeError("the table was changed by another writer; open it again")
        self._segments, self._version = segments, version

    def _path(self) -> str:
        return f"{self.root}/segments/{uuid.uuid4().hex}"

    def _read(self, key: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(s[key]).withColumn("seq", F.lit(i)) for i, s in enumerate(self._segments) if key in s]
        if not parts:
            return self.spark.createDataFrame([], schema + ", seq int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def frame(self) -> DataFrame:
        """All pairs (k, v), unordered."""
        rows = self._read("put", "k binary, v binary")
        if any("del" in s for s in self._segments):
            gone = self._read("del", "k binary").groupBy("k").agg(F.max("seq").alias("gone"))
            rows = rows.join(gone, "k", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("seq")))
        return rows.select("k", "v")

    def scan(self) -> DataFrame:
        """All pairs in key order (unsigned bytes)."""
        return self.frame().orderBy("k")

    def get(self, key: bytes) -> bytes | None:
        self._check(key)
        found = self.frame().where(F.col("k") == F.lit(bytearray(key))).select("v").head()
        return bytes(found[0]) if found else None

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The pairs whose key is in keys (k)."""
        return self.frame().join(keys.select("k").distinct(), "k", "left_semi")

    @staticmethod
    def _check(key: bytes) -> None:
        if len(key) != KEY_LENGTH:
            raise ValueError(f"a key has {KEY_LENGTH} bytes, not {len(key)}")

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Insert rows (k, v) whose keys are absent; of equal new keys the first by `order`, or else in the frame as it is read, wins. Returns how many went in."""
        place = F.struct(*[F.col(c) for c in order]) if order else F.monotonically_increasing_id()
        fresh = rows.withColumn("_at", place).groupBy("k").agg(F.min_by("v", "_at").alias("v"))
        bad = F.when(F.coalesce(F.length("k"), F.lit(-1)) != KEY_LENGTH, F.raise_error(F.lit(f"a key has {KEY_LENGTH} bytes"))).when(F.coalesce(F.length("v"), F.lit(MOST_VALUE + 1)) > MOST_VALUE, F.raise_error(F.lit(f"a value has at most {MOST_VALUE} bytes")))
        fresh = fresh.select("k", F.when(bad.cast("string").isNull(), F.col("v")).alias("v"))
        if self._segments:
            fresh = fresh.join(self.frame().select("k"), "k", "left_anti")
        path = self._path()
        fresh.write.parquet(path)
        count = self.spark.read.schema("k binary, v binary").parquet(path).count()
        if count:
            self._commit([*self._segments, {"put": path}])
        return count

    def remove(self, keys: DataFrame) -> int:
        """Remove the keys (k) that are present. Returns how many were."""
        path = self._path()
        present = self.frame().select("k").join(keys.select("k").distinct(), "k", "left_semi")
        present.write.parquet(path)
        count = self.spark.read.schema("k binary").parquet(path).count()
        if count:
            self._commit([*self._segments, {"del": path}])
        return count

    def put_one(self, key: bytes, value: bytes) -> bool:
        self._check(key)
        return self.insert(self.spark.createDataFrame([(bytearray(key), bytearray(value))], "k binary, v binary")) == 1

    def remove_one(self, key: bytes) -> bool:
        self._check(key)
        return self.remove(self.spark.createDataFrame([(bytearray(key),)], "k binary")) == 1

    def compact(self) -> None:
        """Rewrite the table as one segment, range-sorted by key."""
        path = self._path()
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.frame().repartitionByRange(n, "k").sortWithinPartitions("k").write.parquet(path)
        self._commit([{"put": path}])

    def close(self) -> None:
        """Nothing is buffered, so there is nothing to flush; may be called again."""
