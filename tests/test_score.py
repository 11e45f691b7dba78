"""Scores to the last bit as DuckDB computes them, so that rows that score the same there are in one order here."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skeinflow.operators import score


def test_power_and_logarithm_are_those_of_the_c_library(spark):
    import duckdb

    con = duckdb.connect()
    days = spark.range(400).select("id", score.halved(F.col("id").cast("double") / 6.0).alias("x")).collect()
    assert {r["id"]: r["x"] for r in days} == dict(con.execute("SELECT i, pow(0.5::DOUBLE, i::DOUBLE / 6.0::DOUBLE) FROM range(400) t(i)").fetchall())
    logs = spark.range(1, 20000).select("id", score.log10(F.col("id") * 1e4 / 1e6).alias("x")).collect()
    assert {r["id"]: r["x"] for r in logs} == dict(con.execute("SELECT i, log10(i * 1e4::DOUBLE / 1e6::DOUBLE) FROM range(1, 20000) t(i)").fetchall())


def test_no_logarithm_and_far_days(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (None,), (math.inf,)], "x double")
    assert [r[0] for r in rows.select(score.log10("x")).collect()] == [None, None, None, math.inf]
    assert [r[0] for r in spark.createDataFrame([(None,), (1e6,)], "x double").select(score.halved("x")).collect()] == [None, 0.0]


def test_events_that_score_the_same_are_ordered_by_number(spark, tmp_path):
    """Two events of one score in DuckDB, which were a bit apart in Spark."""
    from skeinflow.plans import selection  # noqa: F401 - it registers the query
    from skeinflow.plans.registry import QUERIES

    e = spark.createDataFrame([(1143343, "2024-01-13 23:00:05", 118, "click", 8.03, '{"k": 20}'), (2241631, "2024-01-13 10:37:06", 67, "view", 80.3, '{"k": 66}')], "event_id long, t string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["id"] for r in QUERIES["day_tiers"](spark, str(tmp_path)).orderBy("place").collect()] == [1143343, 2241631]
