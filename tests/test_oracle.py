"""Every registered query of the engine gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rillflow.plans import catalogue, streams  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, tmp_path, name):
    out = f"{tmp_path}/out"
    catalogue.QUERIES[name](spark, SF).write.parquet(out)
    if name not in catalogue.SQL:
        assert db.execute(f"SELECT count(*) FROM '{out}/*.parquet'").fetchone()[0] > 0
        return
    db.execute(f"CREATE OR REPLACE TABLE want AS {catalogue.SQL[name]}")
    types = dict(r[:2] for r in db.execute("DESCRIBE want").fetchall())
    assert types == dict(r[:2] for r in db.execute(f"DESCRIBE SELECT * FROM '{out}/*.parquet'").fetchall())
    columns = ", ".join(sorted(types))
    got, want = f"SELECT {columns} FROM '{out}/*.parquet'", f"SELECT {columns} FROM want"
    for a, b in ((got, want), (want, got)):
        assert db.execute(f"SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))").fetchone()[0] == 0


@pytest.fixture(scope="module")
def fine(tmp_path_factory):
    """Events fractions of a millisecond apart, on both sides of each window's end and of the watermarks."""
    folder = str(tmp_path_factory.mktemp("fine"))
    us = "i // 60 * 1200000000 + i % 2 * 1001000 + CAST(hash(i) % 6000 AS BIGINT) - 3000"
    sql = f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds({us}) AS ts, i % 3 AS user_id, CASE WHEN i % 4 < 2 THEN 'signup' ELSE 'view' END AS event_type FROM range(3000) t(i)"
    duckdb.execute(f"COPY ({sql}) TO '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize("name", ["late_split", "late_split_punctuated", "late_split_periodic", "stream_late_split_punctuated", "allowed_lateness", "stream_allowed_lateness", "stream_allowed_lateness_batches"])
def test_fractions_of_a_millisecond(spark, fine, tmp_path, name):
    catalogue.QUERIES[name](spark, fine).write.parquet(f"{tmp_path}/out")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{fine}/events.parquet'")
    c.execute(f"CREATE TABLE want AS {catalogue.SQL[name]}")
    columns = ", ".join(r[0] for r in c.execute("DESCRIBE want").fetchall())
    got, want = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", "SELECT * FROM want"
    for a, b in ((got, want), (want, got)):
        assert c.execute(f"SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))").fetchone()[0] == 0


def same_as_sql(spark, name, events, folder):
    """The query on events (SQL) gives the rows of its SQL."""
    os.makedirs(f"{folder}/in")
    c = duckdb.connect()
    c.execute(f"COPY ({events}) TO '{folder}/in/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/in/events.parquet'")
    catalogue.QUERIES[name](spark, f"{folder}/in").write.parquet(f"{folder}/out")
    c.execute(f"CREATE TABLE want AS {catalogue.SQL[name]}")
    columns = ", ".join(r[0] for r in c.execute("DESCRIBE want").fetchall())
    got, want = f"SELECT {columns} FROM '{folder}/out/*.parquet'", "SELECT * FROM want"
    return not any(c.execute(f"SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))").fetchone()[0] for a, b in ((got, want), (want, got)))


@pytest.mark.parametrize("name", ["late_split_punctuated", "late_split_periodic"])
def test_a_row_without_id_comes_last(spark, tmp_path, name):
    assert same_as_sql(spark, name, f"SELECT * REPLACE (CASE WHEN event_id <> 77 THEN event_id END AS event_id) FROM '{SF}/events.parquet'", tmp_path)


def test_periods_below_zero(spark, tmp_path):
    assert same_as_sql(spark, "late_split_periodic", f"SELECT * REPLACE (event_id - 500 AS event_id) FROM '{SF}/events.parquet'", tmp_path)


ODD_TIMES = {
    "null": "CASE WHEN event_id % 9 <> 0 THEN ts END",
    "before 1970": "ts - INTERVAL '54 years 15 days'",
    "beyond 2100": "ts + INTERVAL '200 years'",
}


@pytest.mark.parametrize("times", ODD_TIMES)
@pytest.mark.parametrize("name", ["allowed_lateness", "stream_allowed_lateness_batches"])
def test_windows_of_odd_times(spark, tmp_path, name, times):
    assert same_as_sql(spark, name, f"SELECT * REPLACE ({ODD_TIMES[times]} AS ts) FROM '{SF}/events.parquet'", tmp_path)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.SQL) <= set(entry.oracle_sql())


def test_approximate_counts_are_near(spark):
    exact = {r.window_start: r.uv for r in catalogue.uv_exact_hourly(spark, SF).collect()}
    approx = {r.window_start: r.uv for r in catalogue.uv_approx_hourly(spark, SF).collect()}
    bloom = {r.window_start: r.uv for r in catalogue.uv_bloom_hourly(spark, SF).collect()}
    assert exact.keys() == approx.keys() == bloom.keys()
    assert all(abs(approx[k] - n) <= max(1, 0.05 * n) and bloom[k] <= n and bloom[k] >= 0.95 * n for k, n in exact.items())
