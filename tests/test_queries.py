"""Registered queries against their SQL on small tables with rows that the driver's tables hold only when they are large."""

import duckdb
import pytest

from repograph.functions import scalars as S
from repograph.plans import adapters, catalog


@pytest.fixture
def tables(tmp_path):
    """Three orders of three customers, parts of more than a TB, and events on either side of half a millisecond and of an hour."""
    run = lambda name, sql: duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    run("region", "SELECT 0 AS r_regionkey, 'R' AS r_name")
    run("nation", "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey")
    run("customer", "SELECT range AS c_custkey, 'c' || range AS c_name, 0 AS c_nationkey FROM range(3)")
    run("orders", "SELECT range AS o_orderkey, range % 3 AS o_custkey, TIMESTAMP '2024-01-01' AS o_orderdate FROM range(30)")
    run("part", "SELECT unnest([1, 3, 5, 2000, 131071, 131072, 131073, 200001])::BIGINT AS p_partkey")
    run("events", """SELECT row_number() OVER () - 1 AS event_id, make_timestamp(b + o) AS ts, (row_number() OVER ()) % 7 AS user_id, (['click', 'view', 'error', 'purchase', 'signup'])[CAST(1 + (row_number() OVER ()) % 5 AS INTEGER)] AS event_type
        FROM (SELECT unnest([86400000000, 1704067200000000, 1704070800000000, 1704074400000000]) AS b), (SELECT unnest([-1500, -501, -500, -499, -1, 0, 499, 500, 501, 1500]) AS o)""")
    return str(tmp_path)


def same(spark, folder, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "part", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalog.ORACLES[name]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect())) == sorted(want)


def test_milliseconds_as_in_the_sql(spark, tables):
    times = duckdb.execute(adapters.duck("SELECT event_id, ts_ms FROM numbered").replace("FROM events", f"FROM '{tables}/events.parquet'").replace("FROM orders", f"FROM '{tables}/orders.parquet'")).fetchall()
    assert sorted(map(tuple, adapters.load(spark, tables, "numbered").select("event_id", "ts_ms").collect())) == sorted(times)


def test_windows_of_rounded_milliseconds(spark, tables):
    same(spark, tables, "metrics_windows")


def test_milliseconds_are_rounded_away_from_zero(spark):
    rows = spark.sql("SELECT timestamp_micros(m) AS t FROM VALUES (-1500L), (-501L), (-500L), (-499L), (0L), (499L), (500L), (1499L) AS v(m)").select(S.epoch_ms("t").alias("ms"))
    assert [r.ms for r in rows.collect()] == [-2, -1, -1, 0, 0, 0, 1, 1]


def test_sizes_beyond_a_terabyte(spark, tables):
    same(spark, tables, "formatted_sizes")


def test_parsed_rows_are_those_of_the_views(spark, tables):
    """Parsed rows as the views have them, without the variables being made for them."""
    duckdb.execute(f"COPY (SELECT range % 30 AS l_orderkey, range AS l_partkey, range AS l_suppkey, range % 4 AS l_linenumber FROM range(90)) TO '{tables}/lineitem.parquet' (FORMAT parquet)")
    view = lambda name: adapters.load(spark, tables, name)
    for name, got in zip(("old_edges", "new_nodes", "new_edges"), catalog._parsed(view)):
        rows = sorted(map(str, got.select(*view(name).columns).collect()))
        assert rows and rows == sorted(map(str, view(name).collect())), name
