"""Table sources and key-value tables."""

import random

import pytest
from pyspark.sql import functions as F

from weftlog.functions.keys import encode_key, key_int
from weftlog.functions.rowcodec import encode_frame, encode_row
from weftlog.operators.kv import MOST_VALUE, KeyValueTable
from weftlog.plans import catalogue
from weftlog.plans.catalogue import DOCUMENTS, EVENTS, ORDERS, PART, QUERIES
from weftlog.sources import table as table_module
from weftlog.sources.table import ParquetSource, RowSource, looked_up, parts, write_files
from weftlog.types import Schema, SchemaError

SCORES = Schema.of(id="Int64", name="String", score="Double", active="Bool")


def scores(spark, ids):
    return spark.createDataFrame([(i, f"row{i}", i * 1.5, i % 2 == 0) for i in ids], SCORES.spark())


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scores"))
    return ParquetSource(spark, SCORES, write_files(scores(spark, range(100)), folder + "/a", 1, "zlib", ["id"]) + [folder + "/absent.parquet"])


def test_projections(source):
    assert source.collect_projected([2, 0])[:3] == [(0.0, 0), (1.5, 1), (3.0, 2)]
    assert source.collect_projected([1, 3])[4] == ("row4", True)
    assert source.scan([]).count() == 100 and source.scan([]).columns == []
    assert source.scan([0, 0]).columns == ["id", "id_1"]
    assert source.row_count() == 100
    for bad in (4, -1):
        with pytest.raises(IndexError):
            source.scan([bad])


def test_projection_reaches_the_scan(source):
    plan = source.scan([2])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<score:double>" in plan


def test_ranges(source):
    kinds = [f.type for f in next(iter(source.batches())).schema]
    assert [str(k) for k in kinds] == [{"Int32": "int32", "Int64": "int64", "Float": "float", "Double": "double", "Bool": "bool", "String": "string", "Blob": "binary"}[f.type] for f in source.schema.fields]
    ids = lambda a, n: sorted(r.id for r in source.read_range(a, n, [0]).collect())
    assert ids(0, 30) + ids(30, 25) + ids(55, 45) == list(range(100))
    assert ids(90, 1000) == list(range(90, 100)) and ids(100, 5) == [] and ids(3, 0) == []


def test_windows_and_batches(source):
    assert sorted(r["rows"] for r in source.windows(32).collect()) == [4, 32, 32, 32]
    assert [b.num_rows for b in source.batches([0], 32)] == [32, 32, 32, 4]
    assert [b.num_rows for b in source.batches([0], 0)][:2] == [1, 1]


def test_files_in_list_order(spark, tmp_path):
    a = write_files(scores(spark, range(3)), f"{tmp_path}/a", order=["id"])
    b = write_files(scores(spark, [100, 101]), f"{tmp_path}/b", order=["id"])
    assert [r[0] for r in ParquetSource(spark, SCORES, b + a).collect_projected([0])] == [100, 101, 0, 1, 2]
    assert ParquetSource(spark, SCORES, [f"{tmp_path}/none"]).scan().count() == 0
    with pytest.raises(FileNotFoundError):
        ParquetSource(spark, SCORES, [f"{tmp_path}/none"], required=True)


def test_schema_checks(spark):
    with pytest.raises(SchemaError):
        SCORES.check(spark.range(1))
    with pytest.raises(SchemaError):
        Schema.of(x="Decimal")
    nulls = spark.createDataFrame([(None, "a", 1.0, True)], SCORES.spark())
    with pytest.raises(Exception, match="null in id"):
        SCORES.strict(nulls).collect()


def test_rows_in_key_order(spark, tmp_path):
    ids = list(range(-125, 125))
    random.Random(1).shuffle(ids)
    table = KeyValueTable(spark, str(tmp_path / "kv"))
    assert table.insert(encode_frame(scores(spark, ids), SCORES, key_int(F.col("id")))) == 250
    again = RowSource(SCORES, KeyValueTable(spark, str(tmp_path / "kv")).frame)
    assert again.collect_projected([0, 2]) == [(i, i * 1.5) for i in range(-125, 125)]
    assert [b.num_rows for b in again.batches([0], 100)] == [100, 100, 50]


def test_key_value(spark, tmp_path):
    table = KeyValueTable(spark, str(tmp_path / "kv"))
    assert table.get(encode_key(5)) is None and table.scan().count() == 0
    assert table.put_one(encode_key(5), b"1") and not table.put_one(encode_key(5), b"2")
    assert table.get(encode_key(5)) == b"1"
    assert table.put_one(encode_key(9), b"a\0b") and table.remove_one(encode_key(9)) and not table.remove_one(encode_key(9))
    assert table.put_one(encode_key(9), b"again") and table.get(encode_key(9)) == b"again"
    rows = spark.createDataFrame([(bytearray(encode_key(7)), bytearray(b"late"), 2), (bytearray(encode_key(7)), bytearray(b"first"), 1)], "k binary, v binary, n int")
    assert table.insert(rows, ["n"]) == 1 and table.get(encode_key(7)) == b"first"
    table.compact()
    table.close()
    table.close()
    assert [bytes(r.v) for r in KeyValueTable(spark, str(tmp_path / "kv")).scan().collect()] == [b"1", b"first", b"again"]
    with pytest.raises(ValueError):
        table.get(b"short")
    for k, v in ((b"short", b"x"), (encode_key(1), b"x" * (MOST_VALUE + 1))):
        with pytest.raises(Exception, match="bytes"):
            table.insert(spark.createDataFrame([(bytearray(k), bytearray(v))], "k binary, v binary"))


def test_two_handles_conflict(spark, tmp_path):
    one, two = (KeyValueTable(spark, str(tmp_path / "kv")) for _ in range(2))
    one.put_one(encode_key(1), b"x")
    with pytest.raises(RuntimeError, match="another writer"):
        two.put_one(encode_key(2), b"y")


def test_encode_row_matches_stored(spark, tmp_path):
    table = KeyValueTable(spark, str(tmp_path / "kv"))
    table.insert(encode_frame(scores(spark, [3]), SCORES, key_int(F.col("id"))))
    assert table.get(encode_key(3)) == encode_row(SCORES, (3, "row3", 4.5, False))


@pytest.mark.parametrize("most", [0, 100_000])
def test_files_keep_their_place_by_either_join(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(table_module, "BROADCAST_PAIRS", most)
    schema = Schema.of(id="Int64")
    folder = str(tmp_path / "a folder")
    files = write_files(spark.range(40).select(F.col("id")), folder, 4, order=["id"])
    source = ParquetSource(spark, schema, files[::-1])
    want = [r.id for f in files[::-1] for r in spark.read.parquet(f).orderBy("id").collect()]
    assert [r[0] for r in source.collect_projected()] == want
    assert source.scan().count() == 40
    unlisted = looked_up(spark.createDataFrame([("b",)], "k string"), "k", [("a", 1)], "n", "int")
    with pytest.raises(Exception, match="unlisted file b"):
        unlisted.collect()


def test_first_of_equal_keys_in_the_frame_wins(spark, tmp_path):
    table = KeyValueTable(spark, str(tmp_path / "kv"))
    rows = spark.range(0, 400, 1, 8).select(key_int(F.col("id") % 5).alias("k"), F.col("id").cast("string").cast("binary").alias("v"))
    assert table.insert(rows) == 5
    assert [bytes(r.v) for r in table.scan().collect()] == [b"0", b"1", b"2", b"3", b"4"]


def test_parts_by_the_sizes_of_values(spark, monkeypatch):
    rows = [(1, "é", bytearray(b"abc"), True), (2, None, None, None)]
    df = spark.createDataFrame(rows, "id long, s string, b binary, `a.b` boolean")
    sizes = 2 * 8 + 2 * 8 + 2 + 3
    for most, n in ((sizes, 1), (sizes - 1, 2), (sizes // 4, 5), (1, sizes)):
        monkeypatch.setattr(table_module, "PART_BYTES", most)
        assert parts(df) == n and parts(df, 3) == max(3, n)
    assert parts(df.limit(0)) == 1 and parts(df.limit(0), 4) == 4


@pytest.mark.parametrize("least", [1, 4])
def test_large_tables_are_written_by_more_tasks(spark, tmp_path, monkeypatch, least):
    df = spark.range(2000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    monkeypatch.setattr(table_module, "PART_BYTES", 10_800, raising=False)
    files = write_files(df.repartition(3), f"{tmp_path}/t", least, "zlib", ["id"])
    assert len(files) == 20
    ranges = [[r.id for r in spark.read.parquet(f).collect()] for f in files]
    assert [i for ids in ranges for i in ids] == list(range(2000))
    assert max(map(len, ranges)) <= 200
    assert 3 <= len(write_files(df.repartition(30), f"{tmp_path}/u")) <= 20
    monkeypatch.setattr(table_module, "PART_BYTES", 1 << 27)
    assert len(write_files(df.repartition(3), f"{tmp_path}/v", least, "zlib", ["id"])) == least


@pytest.mark.parametrize("name, table, columns", [("multi_file_concat", "orders", ORDERS.names), ("missing_file_skipped", "orders", ["o_orderkey", "o_totalprice"]), ("write_read_uncompressed", "part", PART.names), ("write_read_deflate", "documents", DOCUMENTS.names), ("columnar_file_roundtrip", "part", ["p_retailprice", "p_name"]), ("stream_ingest", "events", EVENTS.names)])
def test_queries_write_more_files_for_larger_tables(spark, monkeypatch, name, table, columns):
    monkeypatch.setattr(table_module, "PART_BYTES", {"documents": 50_000, "part": 2_000, "events": 5_000}.get(table, 10_000), raising=False)
    found = []
    monkeypatch.setattr(table_module, "parts", lambda *a: found.append(parts(*a)) or found[-1])
    monkeypatch.setattr(catalogue, "parts", table_module.parts)
    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    assert found[0] > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
