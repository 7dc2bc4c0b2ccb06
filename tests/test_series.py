"""Series operators on hand tables, and range-wise against plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import series

BY = ["country", "heading"]


def _panel(spark, rows):
    return spark.createDataFrame(rows, "country string, heading string, year int, v double")


@pytest.mark.parametrize("chunk", [None, 1, 3, 1000])
def test_lags_count_rows_over_gaps(spark, chunk):
    df = _panel(spark, [("PL", "Core", y, float(v)) for y, v in [(1, 1), (2, 2), (5, 3), (6, 9)]])
    df = series.lags(df, "v", BY, "year", chunk=chunk)
    df = series.rolling_mean_prev(df, "v", BY, "year", chunk=chunk)
    df = series.yoy_change(df, "v", BY, "year", chunk=chunk)
    rows = df.orderBy("year").collect()
    assert [r.lag1 for r in rows] == [None, 1.0, 2.0, 3.0]
    assert [r.lag3 for r in rows] == [None, None, None, 1.0]
    assert [r.roll_mean_3 for r in rows] == [None, 1.0, 1.5, 2.0]
    assert [r.yoy_change for r in rows] == [None, 1.0, 1.0, 6.0]


@pytest.mark.parametrize("chunk, fan", [(1, 64), (1, 2), (2, 3), (7, 2), (50, 64)])
def test_ranges_equal_plain_windows(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(series, "FAN", fan)
    random.seed(chunk)
    rows = []
    for country in ("A", "B", None):
        for heading in ("x", "y"):
            for year in random.sample(range(-60, 120), 70):
                value = None if random.random() < 0.2 else round(random.uniform(-9, 9), 4)
                rows.append((country, heading, year, value))
    df = _panel(spark, rows)
    cols = ["country", "heading", "year", "v", "lag1", "lag2", "lag3"]
    plain = series.lags(df, "v", BY, "year").select(cols)
    cut = series.lags(df, "v", BY, "year", chunk=chunk).select(cols)
    assert cut.count() == len(rows)
    assert plain.exceptAll(cut).count() == 0


def test_zscores_agree_and_center(spark):
    random.seed(2)
    rows = [(c, h, y, random.gauss(5, 3)) for c in "AB" for h in "xyz" for y in range(30)]
    df = _panel(spark, rows)
    joined = series.zscore(df, "v", BY, "z")
    plain = df.withColumn("z", series.zscore_over("v", BY))
    assert joined.select(plain.columns).exceptAll(plain).count() == 0
    means = joined.groupBy(*BY).agg(F.avg("z").alias("m")).collect()
    assert all(abs(r.m) < 1e-3 for r in means)


def test_zscore_without_spread_is_null(spark):
    rows = [("A", "x", y, 0.1) for y in range(3)] + [("B", "x", 1, 7.0), (None, "x", 1, 1.0)]
    df = _panel(spark, rows)
    assert [r.z for r in series.zscore(df, "v", BY, "z").collect()] == [None] * 5
    assert [r.z for r in df.select(series.zscore_over("v", BY).alias("z")).collect()] == [None] * 5


def test_no_window_holds_all_ranges_of_a_series(spark):
    """One series of 2,000 ranges with four children a node: windows see four rows at most."""
    rows = [(y, float(y)) for y in range(0, 4000, 2)]
    tails = spark.createDataFrame(rows, "_chunk long, v double").select(
        F.lit("A").alias("country"), "_chunk", F.array(F.struct(F.col("_chunk").alias("year"), F.col("v").alias("_v"))).alias("_tail")
    )
    found = series._carries(tails, ["country"], 3, 4)
    got = {r._chunk: [v._v for v in r._carry] for r in found.collect()}
    assert got == {y: [float(x) for x in range(max(0, y - 6), y, 2)] for y in range(0, 4000, 2)}
    # every level is a stored table of a quarter of the rows, and only the top is one window
    text = found._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("], [")[-2] for line in text.split("\n") if "Window [" in line]
    assert len(keys) >= 5 and sum("_parent" not in k for k in keys) == 1
