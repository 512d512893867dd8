"""Keys, row blobs, digests and columnar files."""

import struct
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlog.functions.digest import lanes
from weftlog.functions.keys import decode_int, encode_key, key_double, key_int
from weftlog.functions.rowcodec import _fields, decode_frame, decode_row, encode_frame, encode_row
from weftlog.sources import columnar
from weftlog.sources.columnar import Columnar, Compression, encode_file, read_dbc1, write_dbc1
from weftlog.types import Schema, SchemaError

SCORES = Schema.of(id="Int64", name="String", score="Double", active="Bool")
BIG, SMALL = sys.float_info.max, sys.float_info.min
VALUES = {
    "int64": [-(2**63), -1234567890, -1, 0, 1, 1234567890, 2**63 - 1],
    "int32": [-(2**31), -100, -1, 0, 1, 100, 2**31 - 1],
    "double": [-BIG, -3.14, -1.0, -SMALL, 0.0, SMALL, 1.0, 3.14, BIG],
    "bool": [False, True],
}


@pytest.mark.parametrize("kind", VALUES)
def test_key_order(kind):
    keys = [encode_key(v) for v in VALUES[kind]]
    assert keys == sorted(keys) and all(len(k) == 8 for k in keys)


def test_known_keys():
    known = {-(2**63): "0000000000000000", -5: "7FFFFFFFFFFFFFFB", 0: "8000000000000000", 7: "8000000000000007", 2**63 - 1: "FFFFFFFFFFFFFFFF"}
    assert {k: encode_key(k).hex().upper() for k in known} == known
    assert encode_key(True) == encode_key(1)
    assert encode_key(-0.0) < encode_key(0.0) and encode_key(float("inf")) < encode_key(float("nan"))


def test_keys_in_spark(spark):
    ints, doubles = VALUES["int64"], [*VALUES["double"], -0.0, float("inf"), float("-inf")]
    got = spark.createDataFrame([(v,) for v in ints], "v long").select("v", key_int(F.col("v")).alias("k"), decode_int(key_int(F.col("v"))).alias("back")).collect()
    assert all(bytes(r.k) == encode_key(r.v) and r.back == r.v for r in got)
    got = spark.createDataFrame([(v,) for v in doubles], "v double").select("v", key_double(F.col("v")).alias("k")).collect()
    assert all(bytes(r.k) == encode_key(r.v) for r in got)
    mixed = spark.createDataFrame([(5, True)], "i int, b boolean").select(key_int(F.col("i")).alias("i"), key_int(F.col("b")).alias("b")).head()
    assert bytes(mixed.i) == encode_key(5) and bytes(mixed.b) == encode_key(1)


@settings(max_examples=50, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(), st.floats(allow_nan=False), st.booleans())
def test_row_roundtrip(i, name, score, active):
    row = (i, name, score, active)
    blob = encode_row(SCORES, row)
    assert decode_row(SCORES, blob) == row
    assert decode_row(SCORES, blob + b"more", [3, 1]) == (active, name)


def test_row_errors():
    blob = encode_row(SCORES, (42, "a\0b", -0.25, False))
    for bad in (blob[:4], struct.pack("<q", 1) + b"\xff\xff\xff\xff"):
        with pytest.raises(SchemaError):
            decode_row(SCORES, bad)
    with pytest.raises(SchemaError):
        encode_row(SCORES, (1, "x"))
    with pytest.raises(SchemaError):
        decode_row(Schema.of(s="String"), b"\x01\0\0\0\xff")


def test_row_frames(spark):
    rows = [(i, f"row{i}é\0", i * 1.5, i % 2 == 0) for i in range(250)] + [(-1, "", -0.0, True)]
    df = spark.createDataFrame(rows, SCORES.spark())
    blobs = encode_frame(df, SCORES, key_int(F.col("id")))
    assert {bytes(r.v) for r in blobs.collect()} == {encode_row(SCORES, r) for r in rows}
    assert sorted(map(tuple, decode_frame(blobs, SCORES).collect())) == sorted(rows)
    assert sorted(map(tuple, decode_frame(blobs, SCORES, [2, 0, 0]).collect())) == sorted((r[2], r[0], r[0]) for r in rows)
    assert decode_frame(blobs, SCORES, []).count() == 251


def test_double_keys_of_all_magnitudes(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(-(2**63), 2**63 - 1, 20000)
    edges = [v for e in range(-1074, 1024) for p in [2.0**e] for v in (p, -p, np.nextafter(p, 0), np.nextafter(p, np.inf))]
    doubles = [float(v) for v in [*bits.view(np.float64), *edges, np.inf, -np.inf] if not np.isnan(v)] + [0.0, -0.0, float("nan")]
    got = spark.createDataFrame([(v,) for v in doubles], "v double").select("v", key_double(F.col("v")).alias("k"))
    rows = got.collect()
    assert all(bytes(r.k) == encode_key(r.v) for r in rows)
    wide = spark.createDataFrame([(0.1,), (-0.0,)], "v float").select(key_double(F.col("v")).alias("k")).collect()
    assert [bytes(r.k) for r in wide] == [encode_key(float(np.float32(0.1))), encode_key(-0.0)]


EVERY = Schema.of(i="Int32", s="String", d="Double", t="Bool", b="Blob", f="Float", l="Int64")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**31), 2**31 - 1), st.text(max_size=30), st.floats(allow_nan=False), st.booleans(), st.binary(max_size=30), st.floats(width=32, allow_nan=False), st.integers(-(2**63), 2**63 - 1)), max_size=8))
def test_blobs_decode_together_as_alone(rows):
    blobs = [encode_row(EVERY, r) + b"more" for r in rows]
    held = pa.array([b"before", *blobs], pa.binary()).slice(1)
    for wanted in ([0, 1, 2, 3, 4, 5, 6], [4, 1], [6, 0], []):
        got = [c.to_pylist() for c in _fields(EVERY, held, wanted)]
        want = [decode_row(EVERY, b, wanted) for b in blobs]
        assert got == [[r[j] for r in want] for j in range(len(wanted))]


def test_broken_blobs_are_errors_together_too():
    good = encode_row(SCORES, (1, "x", 0.5, True))
    for bad in (good[:4], good[:-1], b"", struct.pack("<q", 1) + b"\xff\xff\xff\xff", None):
        with pytest.raises(SchemaError):
            _fields(SCORES, pa.array([good, bad], pa.binary()), [0])
    with pytest.raises(SchemaError):
        _fields(Schema.of(s="String"), pa.array([b"\x01\0\0\0\xff"], pa.binary()), [0])


def test_digest_is_bound_to_places(spark):
    one = spark.createDataFrame([(0, 0.0), (1, -0.0)], "p long, v double")
    two = spark.createDataFrame([(0, -0.0), (1, 0.0)], "p long, v double")
    digest = lambda df: tuple(df.agg(*lanes(df, ["p"], ["v"])).head())
    assert digest(one) == digest(one.repartition(3)) != digest(two)


GOLDEN = bytes.fromhex(
    "4442433101000000020000000200000068690300000078797a02000000000000"
    "0002000000000000000101040000000000000008000000000000000800000000"
    "000000020000000000000001010c000000000000000d000000000000000d0000"
    "00000000000200000000000000540000000000000044424331"
)
PAIR = Schema.of(a="Int32", b="String")


def _open(data, schema, spy=None):
    def read(offset, length):
        if spy is not None:
            spy.append(length)
        return data[offset : offset + length]

    return Columnar(schema, len(data), read)


def test_columnar_golden():
    table = pa.table({"a": pa.array([1, 2], pa.int32()), "b": ["hi", "xyz"]})
    assert encode_file(PAIR, table) == GOLDEN
    batch = _open(GOLDEN, PAIR).read_range(0, 10, [1, 0])
    assert [c.to_pylist() for c in batch.columns] == [["hi", "xyz"], [1, 2]]


@pytest.mark.parametrize("codec", ["none", "zlib"])
def test_columnar_ranges(codec):
    schema = Schema.of(i="Int32", d="Double", f="Float", t="Bool", s="String", b="Blob")
    n = 100
    table = pa.table([pa.array(range(n), pa.int32()), pa.array(np.arange(n) * 1.5), pa.array(np.arange(n), pa.float32()), pa.array([i % 2 == 0 for i in range(n)]), pa.array([f"r{i}" for i in range(n)]), pa.array([bytes([i, 255]) for i in range(n)])], names=list("idftsb"))
    file = _open(encode_file(schema, table, codec), schema)
    for first, count, rows in ((0, 30, 30), (90, 1000, 10), (55, 45, 45)):
        assert pa.Table.from_batches([file.read_range(first, count)]).to_pydict() == dict(zip(map(str, range(6)), table.slice(first, rows).to_pydict().values(), strict=True))
    assert file.read_range(100, 5) is None and file.read_range(3, 0) is None
    assert file.read_range(0, 7, []).num_rows == 7
    with pytest.raises(IndexError):
        file.read_range(0, 1, [9])


def test_columnar_reads_few_bytes():
    schema = Schema.of(id="Int64", name="String")
    table = pa.table({"id": range(1000), "name": [f"row{i}" for i in range(1000)]})
    spy = []
    file = _open(encode_file(schema, table), schema, spy)
    spy.clear()
    assert file.read_range(500, 4, [0]).column(0).to_pylist() == [500, 501, 502, 503]
    assert sum(spy) <= 64
    spy.clear()
    file.read_range(500, 4, [1])
    assert sum(spy) > 1000


def test_columnar_errors():
    with pytest.raises(SchemaError):
        _open(GOLDEN[:-1] + b"X", PAIR)
    with pytest.raises(SchemaError):
        _open(GOLDEN, SCORES)
    with pytest.raises(SchemaError):
        Compression.unpack(7, b"", 0)
    with pytest.raises(SchemaError):
        Compression.unpack(2, b"junk", 4)


def test_columnar_in_spark(spark, tmp_path):
    rows = [(i, f"row{i}", i * 1.5, i % 2 == 0) for i in range(50)]
    write_dbc1(spark.createDataFrame(rows, SCORES.spark()).coalesce(1), str(tmp_path / "t"), "zlib")
    files = [str(p) for p in (tmp_path / "t").glob("*.dbc1")]
    got = read_dbc1(spark, SCORES, [*files, str(tmp_path / "absent")], [2, 0])
    assert sorted(map(tuple, got.collect())) == [(i * 1.5, i) for i in range(50)]


def test_columnar_pages_are_decoded_once(tmp_path, monkeypatch):
    n, decoded, decode = 2000, [], columnar.decode_page
    table = pa.table([pa.array(range(n), pa.int64()), [f"row{i}" for i in range(n)], np.arange(n) * 1.5, [i % 2 == 0 for i in range(n)]], names=SCORES.names)
    (tmp_path / "a.dbc1").write_bytes(encode_file(SCORES, table, "zlib"))
    monkeypatch.setattr(columnar, "decode_page", lambda kind, raw, count: decoded.append(len(raw)) or decode(kind, raw, count))
    reader = columnar._Reader(SCORES, ["score", "name"], [str(tmp_path / "a.dbc1")], 100)
    batches = list(reader.read(reader.partitions()[0]))
    assert [b.num_rows for b in batches] == [100] * 20
    assert pa.Table.from_batches(batches).to_pydict() == table.select(["score", "name"]).to_pydict()
    assert sum(decoded) == 8 * n + sum(4 + len(f"row{i}") for i in range(n))


@pytest.mark.parametrize("codec", ["none", "zlib"])
@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_columnar_batches_are_the_ranges(codec, block, monkeypatch):
    monkeypatch.setattr(columnar, "BLOCK", block, raising=False)
    n = 50
    table = pa.table([pa.array(range(n), pa.int32()), ["é" * (i % 9) for i in range(n)], np.arange(n) * 1.5, [i % 3 == 0 for i in range(n)], [bytes(200 * (i % 2)) for i in range(n)], pa.array(np.arange(n), pa.float32()), pa.array(range(n), pa.int64())], names=EVERY.names)
    file = _open(encode_file(EVERY, table, codec), EVERY)
    for size in (1, 7, 50, 1000):
        for wanted in (None, [4, 1, 1], []):
            got = list(file.batches(size, wanted))
            assert all(a.equals(file.read_range(first, size, wanted)) for a, first in zip(got, range(0, n, size), strict=True))
    assert list(_open(encode_file(EVERY, table.slice(0, 0), codec), EVERY).batches(10)) == []


@pytest.mark.parametrize("codec", ["none", "zlib"])
def test_columnar_batches_check_whole_pages(codec):
    schema = Schema.of(s="String")
    whole = encode_file(schema, pa.table({"s": [f"row{i}" for i in range(100)]}), codec)
    size = 16 + 34  # of the footer, before its own size and the magic
    at = len(whole) - 12 - size
    stored, raw = struct.unpack_from("<QQ", whole, at + 16 + 2 + 8)
    entry = lambda *v: whole[: at + 18] + struct.pack("<QQQQ", *v) + whole[at + 50 :]
    assert sum(b.num_rows for b in _open(entry(4, stored, raw, 100), schema).batches(30)) == 100
    for bad in (entry(4, stored - 1, raw, 100), entry(4, stored, raw - 1, 100), entry(4, stored, raw + 1, 100), entry(4, stored, raw, 99), whole[:5] + b"\xff" + whole[6:]):
        with pytest.raises(SchemaError):
            list(_open(bad, schema).batches(30))


def test_columnar_sink_begins_new_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"row{i}", i * 1.5, i % 2 == 0) for i in range(500)]
    batches = pa.Table.from_pylist([dict(zip(SCORES.names, r, strict=True)) for r in rows]).to_batches(50)
    monkeypatch.setattr(columnar, "FILE_BYTES", 2 * max(b.nbytes for b in batches), raising=False)
    sink = columnar._Writer(SCORES, str(tmp_path / "t"), "zlib")
    kept, again = sink.write(iter(batches)), sink.write(iter(batches[:3]))
    assert not list((tmp_path / "t").glob("*.dbc1"))
    sink.abort([again, None])
    sink.commit([kept, None])
    files = sorted(map(str, (tmp_path / "t").glob("*")))
    assert len(files) == 5 and all(f.endswith(".dbc1") for f in files)
    assert sorted(map(tuple, read_dbc1(spark, SCORES, files).collect())) == rows


def test_columnar_empty_table(spark, tmp_path):
    write_dbc1(spark.createDataFrame([], SCORES.spark()), str(tmp_path / "t"))
    assert list((tmp_path / "t").glob("*")) == [] and read_dbc1(spark, SCORES, []).count() == 0
