"""The driver's contract, and the engine's queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from weftlog.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame = frame.assign(**{c: frame[c].round(6)})
    return sorted(map(str, frame.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want.astype({c: got[c].dtype for c in got.columns}) if len(got) else want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_probe_window_growth_imports_every_event(spark, monkeypatch):
    made = []
    plain = catalogue._Log
    monkeypatch.setattr(catalogue, "_Log", lambda *args: made.append(plain(*args)) or made[-1])
    assert [tuple(r) for r in catalogue.QUERIES["probe_window_growth"](spark, DATA).collect()] == [(1, 7, 8), (2, 10, 16)]
    assert made[0].scan().count() == spark.read.parquet(f"{DATA}/events.parquet").count()
