"""Every query against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from popspark.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=str)
    if name not in ORACLE_SQL:
        assert rows
        return
    found = oracle.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(df.columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_range_frame_rounds_parts_of_a_second(spark, tmp_path):
    start, us = datetime.datetime(2024, 1, 1), (0, 499_999, 500_000, 500_001, 999_999)
    at = [start + datetime.timedelta(days=k, seconds=s, microseconds=u) for k in (0, 1, 2) for s in (0, 1, 2) for u in us]
    at += [datetime.datetime(1969, 12, 31, 23, 59, s, 500_000) for s in (57, 58, 59)]
    rows = [(i, t, i % 2) for i, t in enumerate(at)] + [(1000, None, 0), (1001, None, 0), (1002, start, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["range_frame"](spark, str(tmp_path)).select("event_id", "n").collect()]
    assert sorted(got) == sorted(c.sql(ORACLE_SQL["range_frame"]).fetchall())
