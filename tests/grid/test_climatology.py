import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridtrack.operators import field_ops


def test_rounded_as_the_sql_rounds(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i, 3), 95 + i, v) for i, v in enumerate([33.5, 13.5, 7.5, 8.5, 67.5])]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["field_climatology"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["field_climatology"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_mean_sums_in_order_of_steps(spark):
    rows = [(20240103, 1, 1, 3.28), (20240118, 1, 1, 48.72), (20240126, 1, 1, 39.76), (20240121, 1, 1, 30.24), (20240101, 1, 1, None), (20240101, 2, 1, None)]
    want = (3.28 + 48.72 + 30.24 + 39.76) / 4
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: -(r[3] or 0))):
        field = spark.createDataFrame(order, "ts long, x int, y int, v double").coalesce(1)
        got = {r["x"]: (r["n"], r["mean"]) for r in field_ops.climatology(field, F.expr("cast(ts div 100 % 100 as int)"), 50.0).collect()}
        assert got == {1: (5, want), 2: (1, None)}
