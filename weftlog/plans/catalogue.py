"""The engine's own queries and the SQL that must give the same rows. Tables a query needs are made in a fresh folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions.keys import encode_key, key_double, key_int
from weftlog.functions.rowcodec import decode_frame, encode_frame
from weftlog.operators.indexer import Indexer
from weftlog.operators.kv import KeyValueTable
from weftlog.operators.objects import FAILED, MetadataStore, read_at, store_at
from weftlog.operators.protocol import Descriptor
from weftlog.operators.services import Catalog, ImportService, OneProcess, QueryService, WriterService, fresh_root, open_files
from weftlog.operators.snapshot import SnapshotSource, Table
from weftlog.operators.writer import DEFERRED, IMMEDIATE, ImportBatch, TableWriter
from weftlog.sources.columnar import read_dbc1, write_dbc1
from weftlog.sources.table import ParquetSource, RowSource, parts, write_files
from weftlog.streaming.ingest import table_sink
from weftlog.types import Schema

EVENTS = Schema.of(event_id="Int64", user_id="Int64", event_type="String", value="Double")
CUSTOMER = Schema.of(c_custkey="Int64", c_name="String", c_nationkey="Int32", c_acctbal="Double", c_mktsegment="String")
PART = Schema.of(p_partkey="Int64", p_name="String", p_brand="String", p_type="String", p_size="Int32", p_retailprice="Double")
ORDERS = Schema.of(o_orderkey="Int64", o_custkey="Int64", o_orderstatus="String", o_totalprice="Double", o_orderpriority="String")
DOCUMENTS = Schema.of(doc_id="Int64", text="String")
LINEITEM = Schema.of(l_orderkey="Int64", l_linenumber="Int32", l_quantity="Double")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _root(spark: SparkSession) -> str:
    """A fresh folder in what driver and executors share; in local runs a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return fresh_root(shared or tempfile.gettempdir())


def _source(spark: SparkSession, sf_dir: str, name: str, schema: Schema) -> ParquetSource:
    return ParquetSource(spark, schema, [f"{sf_dir}/{name}.parquet"])


def _rows(spark: SparkSession, sf_dir: str, name: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema.spark()).parquet(f"{sf_dir}/{name}.parquet")


# Scans and projections.


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_full(spark, sf_dir):
    return _source(spark, sf_dir, "events", EVENTS).scan()


@query("SELECT value, event_id FROM events")
def project_reorder(spark, sf_dir):
    return _source(spark, sf_dir, "events", EVENTS).scan([3, 0])


@query("SELECT c_acctbal, c_custkey FROM customer")
def project_customer(spark, sf_dir):
    return _source(spark, sf_dir, "customer", CUSTOMER).scan([3, 0])


@query("SELECT p_partkey, p_partkey AS p_partkey_1 FROM part")
def project_duplicate(spark, sf_dir):
    return _source(spark, sf_dir, "part", PART).scan([0, 0])


@query("SELECT count(*) AS n FROM lineitem")
def empty_projection_count(spark, sf_dir):
    return _source(spark, sf_dir, "lineitem", LINEITEM).scan([]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return spark.createDataFrame([(_source(spark, sf_dir, "lineitem", LINEITEM).row_count(),)], "n long")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id BETWEEN 500 AND 503")
def read_range(spark, sf_dir):
    return _source(spark, sf_dir, "events", EVENTS).read_range(500, 4)


@query("SELECT event_id, value FROM events WHERE event_id >= (SELECT count(*) - 10 FROM events)")
def read_range_clamp(spark, sf_dir):
    source = _source(spark, sf_dir, "events", EVENTS)
    return source.read_range(source.row_count() - 10, 1000, [0, 3])


@query("SELECT event_id, value FROM events WHERE false")
def read_range_past_end(spark, sf_dir):
    source = _source(spark, sf_dir, "events", EVENTS)
    return source.read_range(source.row_count(), 5, [0, 3])


@query("SELECT 0 AS file, event_id // 1024 AS batch, count(*) AS rows FROM events GROUP BY 2")
def batch_windows(spark, sf_dir):
    return _source(spark, sf_dir, "events", EVENTS).windows()


# Files.


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def multi_file_concat(spark, sf_dir):
    files = write_files(_rows(spark, sf_dir, "orders", ORDERS), f"{_root(spark)}/orders", 3, order=["o_orderkey"])
    return ParquetSource(spark, ORDERS, files).scan()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def missing_file_skipped(spark, sf_dir):
    root = _root(spark)
    files = write_files(_rows(spark, sf_dir, "orders", ORDERS), f"{root}/orders", 3, order=["o_orderkey"])
    return ParquetSource(spark, ORDERS, [files[0], f"{root}/absent.parquet", *files[1:]]).scan([0, 3])


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def write_read_uncompressed(spark, sf_dir):
    files = write_files(_rows(spark, sf_dir, "part", PART), f"{_root(spark)}/part", 1, "none", ["p_partkey"])
    return ParquetSource(spark, PART, files).scan()


@query("SELECT doc_id, text FROM documents")
def write_read_deflate(spark, sf_dir):
    files = write_files(_rows(spark, sf_dir, "documents", DOCUMENTS), f"{_root(spark)}/documents", 4, "zlib", ["doc_id"])
    return ParquetSource(spark, DOCUMENTS, files).scan()


@query("SELECT p_retailprice, p_name FROM part")
def columnar_file_roundtrip(spark, sf_dir):
    folder = _root(spark).removeprefix("file://").removeprefix("file:") + "/part"
    rows = _rows(spark, sf_dir, "part", PART)
    write_dbc1(rows.repartition(parts(rows, 2)), folder, "zlib")
    import os

    return read_dbc1(spark, PART, sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".dbc1")), [5, 1])


# Codecs.


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def row_codec_roundtrip(spark, sf_dir):
    return decode_frame(encode_frame(_rows(spark, sf_dir, "customer", CUSTOMER), CUSTOMER), CUSTOMER)


@query("SELECT c_custkey, c_acctbal FROM customer")
def row_codec_project(spark, sf_dir):
    return decode_frame(encode_frame(_rows(spark, sf_dir, "customer", CUSTOMER), CUSTOMER), CUSTOMER, [0, 3])


_INT_KEY = "format('{{:016X}}', ({}::HUGEINT + 9223372036854775808)::UBIGINT)"
_DOUBLE_KEY = "CASE WHEN left(({0}::BIT)::VARCHAR, 1) = '1' THEN (~({0}::BIT))::VARCHAR ELSE '1' || substr(({0}::BIT)::VARCHAR, 2) END"


@query(f"SELECT x, {_INT_KEY.format('x')} AS k FROM (SELECT o_orderkey - 500 AS x FROM orders)")
def key_int64(spark, sf_dir):
    x = _rows(spark, sf_dir, "orders", ORDERS).select((F.col("o_orderkey") - 500).alias("x"))
    return x.select("x", F.hex(key_int(F.col("x"))).alias("k"))


@query(
    f"SELECT 'int' AS kind, n_nationkey::BIGINT AS x, {_INT_KEY.format('n_nationkey')} AS k FROM nation UNION ALL "
    f"SELECT 'bool', toxic::BIGINT, {_INT_KEY.format('toxic')} FROM labels"
)
def key_int32_bool(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("int").alias("kind"), F.col("n_nationkey").cast("long").alias("x"), F.hex(key_int(F.col("n_nationkey"))).alias("k"))
    flag = F.col("toxic") == 1
    b = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.lit("bool").alias("kind"), flag.cast("long").alias("x"), F.hex(key_int(flag)).alias("k"))
    return a.unionByName(b)


@query(f"SELECT c_custkey, {_DOUBLE_KEY.format('c_acctbal')} AS k FROM customer")
def key_float64(spark, sf_dir):
    k = F.hex(key_double(F.col("c_acctbal")))
    return _rows(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.lpad(F.conv(k, 16, 2), 64, "0").alias("k"))


@query("SELECT c_custkey, rank() OVER (ORDER BY c_acctbal) AS place FROM customer")
def key_order_matches_value_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = _rows(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", key_double(F.col("c_acctbal")).alias("k"))
    return rows.select("c_custkey", F.rank().over(Window.orderBy("k")).cast("long").alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN -100 AND 2500.5")
def key_range_by_bytes(spark, sf_dir):
    """Unsigned byte order of keys selects a value range."""
    low, high = (F.lit(bytearray(encode_key(float(x)))) for x in (-100, 2500.5))
    rows = _rows(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", "c_name", key_double(F.col("c_acctbal")).alias("k"))
    return rows.where((F.col("k") >= low) & (F.col("k") <= high)).drop("k")


# Key-value tables.


def _orders(spark: SparkSession, sf_dir: str, where=None) -> KeyValueTable:
    table = KeyValueTable(spark, _root(spark))
    rows = _rows(spark, sf_dir, "orders", ORDERS)
    table.insert(encode_frame(rows.where(where) if where is not None else rows, ORDERS, key_int(F.col("o_orderkey"))))
    return table


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey IN (3, 77, 410)")
def kv_get_hit(spark, sf_dir):
    table = _orders(spark, sf_dir)
    keys = spark.createDataFrame([(bytearray(encode_key(k)),) for k in (3, 77, 410)], "k binary")
    return decode_frame(table.lookup(keys), ORDERS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey < 0")
def kv_get_miss(spark, sf_dir):
    table = _orders(spark, sf_dir)
    keys = spark.createDataFrame([(bytearray(encode_key(-k)),) for k in (1, 2)], "k binary")
    return decode_frame(table.lookup(keys), ORDERS)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -1.0 END AS o_totalprice FROM orders")
def kv_insert_if_absent(spark, sf_dir):
    table = _orders(spark, sf_dir, F.col("o_orderkey") % 3 == 0)
    other = _rows(spark, sf_dir, "orders", ORDERS).withColumn("o_totalprice", F.lit(-1.0))
    table.insert(encode_frame(other, ORDERS, key_int(F.col("o_orderkey"))))
    return RowSource(ORDERS, table.frame).scan([0, 3])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def kv_remove(spark, sf_dir):
    table = _orders(spark, sf_dir)
    gone = _rows(spark, sf_dir, "orders", ORDERS).where(F.col("o_orderkey") % 7 == 0)
    table.remove(gone.select(key_int(F.col("o_orderkey")).alias("k")))
    return RowSource(ORDERS, table.frame).scan([0, 3])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def kv_ordered_scan_reopen(spark, sf_dir):
    from pyspark.sql import Window

    table = _orders(spark, sf_dir)
    table.compact()
    table.close()
    again = KeyValueTable(spark, table.root)
    rows = decode_frame(again.scan(), ORDERS, [0], ("k",))
    return rows.select("o_orderkey", F.row_number().over(Window.orderBy("k")).cast("long").alias("place"))


# Objects and metadata: small by nature, and so handled on the driver.


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 nations, by number."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey").collect()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'Created' ELSE 'AlreadyExists' END AS outcome FROM nation")
def object_create_if_absent(spark, sf_dir):
    """Of all that create one object, the first one alone does."""
    store = store_at(spark, _root(spark))
    made = [(int(r.n_nationkey), store.create_if_absent(f"region/{r.n_regionkey}", r.n_name.encode())) for r in _nations(spark, sf_dir)]
    return spark.createDataFrame(made, "n_nationkey long, outcome string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, true AS past_end_refused FROM nation")
def object_ranged_read(spark, sf_dir):
    """Each name is a byte range of one object; a range that leaves the object gives nothing."""
    store, nations = store_at(spark, _root(spark)), _nations(spark, sf_dir)
    names = [r.n_name.encode() for r in nations]
    store.put("names", b"".join(names))
    out, at, total = [], 0, sum(map(len, names))
    for r, name in zip(nations, names, strict=True):
        out.append((int(r.n_nationkey), read_at(store, "names", at, len(name)).decode(), read_at(store, "names", at, total - at + 1) is None))
        at += len(name)
    return spark.createDataFrame(out, "n_nationkey long, n_name string, past_end_refused boolean")


@query("SELECT n_regionkey || '/' || n_nationkey AS object FROM nation WHERE n_nationkey % 2 = 1 AND n_regionkey IN (1, 3)")
def object_list_delete(spark, sf_dir):
    """Objects by prefix, after some were deleted (twice: the second time does nothing)."""
    store = store_at(spark, _root(spark))
    for r in _nations(spark, sf_dir):
        store.put(f"{r.n_regionkey}/{r.n_nationkey}", r.n_name.encode())
        for _ in range(2 * (r.n_nationkey % 2 == 0)):
            store.delete(f"{r.n_regionkey}/{r.n_nationkey}")
    return spark.createDataFrame([(k,) for p in ("1/", "3/") for k in store.list(p)], "object string")


@query("SELECT n_regionkey::BIGINT AS n_regionkey, arg_min(n_name, n_nationkey) AS name, count(*) - 1 AS refused FROM nation GROUP BY n_regionkey")
def metadata_put_if_absent(spark, sf_dir):
    """The first value stays; get returns it."""
    store, refused = MetadataStore(store_at(spark, _root(spark))), {}
    for r in _nations(spark, sf_dir):
        done, _ = store.put_if_absent(f"region/{r.n_regionkey}", r.n_name.encode())
        refused[r.n_regionkey] = refused.get(r.n_regionkey, 0) + (done == FAILED)
    return spark.createDataFrame([(int(k), store.get(f"region/{k}")[0].decode(), n) for k, n in refused.items()], "n_regionkey long, name string, refused long")


@query("SELECT n_regionkey::BIGINT AS n_regionkey, arg_max(n_name, n_nationkey) AS name, count(*) AS version, count(*) - 1 AS stale FROM nation GROUP BY n_regionkey")
def metadata_compare_exchange(spark, sf_dir):
    """Each nation swaps its name in by the version that it read; a swap by the version before is refused."""
    store, stale = MetadataStore(store_at(spark, _root(spark))), {}
    for r in _nations(spark, sf_dir):
        key, value = f"region/{r.n_regionkey}", r.n_name.encode()
        if (found := store.get(key)) is None:
            stale[r.n_regionkey] = 0
            store.put_if_absent(key, value)
            continue
        store.compare_exchange(key, found[1], value)
        stale[r.n_regionkey] += store.compare_exchange(key, found[1], b"too late")[0] == FAILED
    rows = [(int(k), *store.get(f"region/{k}"), n) for k, n in stale.items()]
    return spark.createDataFrame([(k, v.decode(), version, n) for k, v, version, n in rows], "n_regionkey long, name string, version long, stale long")


# Log-structured tables.


class _Log:
    """An events table in a fresh folder, with its writer, and its input in as many equal ranges as asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        root = _root(spark)
        self.files = open_files(spark, Descriptor("tenant-a/events", f"{root}/metadata", f"{root}/files", EVENTS))
        self.files.initialise()
        self.table, self.writer, self.indexer = Table(spark, self.files), TableWriter(spark, self.files), Indexer(spark, self.files)
        self.writer.start()
        self.rows = _rows(spark, sf_dir, "events", EVENTS)
        self.count = self.rows.count()

    def part(self, i: int, n: int) -> DataFrame:
        return self.rows.where((F.col("event_id") >= self.count * i // n) & (F.col("event_id") < self.count * (i + 1) // n))

    def add(self, i: int, n: int, mode: str = IMMEDIATE, ids: tuple[str, ...] | None = None, writer: TableWriter | None = None):
        return (writer or self.writer).import_batch(ImportBatch(ids or (f"b{i}",), (self.part(i, n),), mode, ("event_id",)))

    def scan(self, probe: bool = True) -> DataFrame:
        return self.table.open(probe).scan()


_ALL = "SELECT event_id, user_id, event_type, value FROM events"
_HALF = f"{_ALL} WHERE event_id < (SELECT count(*) // 2 FROM events)"


@query(_ALL)
def import_immediate_visible(spark, sf_dir):
    log = _Log(spark, sf_dir)
    for i in range(3):
        log.add(i, 3)
    return log.scan(probe=False)


@query("SELECT event_id, event_id < (SELECT count(*) // 2 FROM events) AS indexed FROM events")
def snapshot_indexed_plus_wal(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 2)
    log.indexer.index()
    log.add(1, 2)
    return log.table.open().rows().select("event_id", (F.col("_src") == 0).alias("indexed"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events")
def snapshot_order(spark, sf_dir):
    from pyspark.sql import Window

    log = _Log(spark, sf_dir)
    log.add(0, 2)
    log.indexer.index()
    log.add(1, 2)
    source = log.table.open()
    return source.rows().select("event_id", F.row_number().over(Window.orderBy(*source.order)).cast("long").alias("place"))


@query(_HALF)
def strict_excludes_deferred(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 2)
    log.add(1, 2, DEFERRED)
    return log.scan(probe=False)


@query(_ALL)
def speculative_includes_deferred(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 2)
    log.add(1, 2, DEFERRED)
    return log.scan()


@query(_ALL)
def immediate_publishes_earlier_deferred(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 2, DEFERRED)
    log.add(1, 2)
    return log.scan(probe=False)


@query(_HALF)
def snapshot_isolation(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 2)
    held = log.table.open()
    log.add(1, 2)
    log.indexer.index()
    return held.scan()


@query(_ALL)
def index_preserves_rows(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 2)
    log.add(1, 2, DEFERRED)
    log.indexer.index()
    return log.scan(probe=False)


@query(f"SELECT *, 'Committed,Committed,AlreadyCommitted,AlreadyCommitted' AS codes FROM ({_ALL})")
def retry_is_idempotent(spark, sf_dir):
    log = _Log(spark, sf_dir)
    codes = [log.add(0, 2).code, log.add(1, 2).code, log.add(0, 2).code]
    log.indexer.index()
    codes.append(log.add(1, 2).code)
    return log.scan(probe=False).withColumn("codes", F.lit(",".join(codes)))


@query(f"SELECT *, 'Durable,Fenced,AlreadyCommitted,Committed' AS codes FROM ({_ALL})")
def fence_failover(spark, sf_dir):
    log = _Log(spark, sf_dir)
    codes = [log.add(0, 2, DEFERRED).code]
    heir = TableWriter(spark, log.files)
    heir.start()
    codes.append(log.add(1, 2).code)
    log.indexer.index()
    codes += [log.add(0, 2, writer=heir).code, log.add(1, 2, writer=heir).code]
    return log.scan(probe=False).withColumn("codes", F.lit(",".join(codes)))


@query("SELECT f.first_seq::BIGINT AS first_seq, f.last_seq::BIGINT AS last_seq, (CASE f.first_seq WHEN 2 THEN count(*) // 2 ELSE count(*) - count(*) // 2 END)::BIGINT AS row_count FROM events, (VALUES (2, 2), (3, 3)) f(first_seq, last_seq) GROUP BY 1, 2, f.first_seq")
def manifest_files(spark, sf_dir):
    log = _Log(spark, sf_dir)
    for i in range(2):
        log.add(i, 2)
        log.indexer.index()
    state, _ = log.files.current()
    return spark.createDataFrame([(f.first_seq, f.last_seq, f.rows) for f in log.files.manifest(state)[0].files], "first_seq long, last_seq long, row_count long")


@query("SELECT * FROM (VALUES (1, 7, 8), (2, 10, 16)) t(probe, chunks, \"window\")")
def probe_window_growth(spark, sf_dir):
    log = _Log(spark, sf_dir)
    for i in range(10):
        log.add(i, 10, DEFERRED)
    out = []
    for i in (1, 2):
        window = log.table.window
        out.append((i, len(log.table.snapshot().log), window))
    return spark.createDataFrame(out, "probe int, chunks int, window int")


@query(_ALL)
def group_commit(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.writer.import_batch(ImportBatch(("a", "b", "c"), tuple(log.part(i, 3) for i in range(3)), IMMEDIATE, ("event_id",)))
    return log.scan(probe=False)


@query(_ALL)
def service_import_query(spark, sf_dir):
    catalog = Catalog(_root(spark))
    catalog.create(spark, "observability", "events", EVENTS)
    imports, queries = ImportService(catalog, OneProcess(WriterService(spark, catalog))), QueryService(spark, catalog)
    imports.import_batch("observability", "events", ImportBatch(("x",), (_rows(spark, sf_dir, "events", EVENTS),), IMMEDIATE, ("event_id",)))
    return queries.open("observability", "events").scan()


@query(_ALL)
def stream_ingest(spark, sf_dir):
    log = _Log(spark, sf_dir)
    root = _root(spark)
    write_files(log.rows, f"{root}/in", 3, order=["event_id"])
    stream = spark.readStream.schema(EVENTS.spark()).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for _ in range(2):  # the second start finds nothing new
        table_sink(stream, log.writer, "ingest", ("event_id",)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return log.scan(probe=False)


def snapshot_sql(spark: SparkSession, source: SnapshotSource, name: str, sql: str) -> DataFrame:
    """Any SQL over a snapshot, through a temporary view."""
    source.scan().createOrReplaceTempView(name)
    return spark.sql(sql)


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def snapshot_view_sql(spark, sf_dir):
    log = _Log(spark, sf_dir)
    log.add(0, 1)
    return snapshot_sql(spark, log.table.open(False), "log_events", "SELECT event_type, count(*) AS n, sum(user_id) AS users FROM log_events GROUP BY event_type")
