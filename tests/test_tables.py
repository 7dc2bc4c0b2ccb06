"""Tables of the catalog."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import series
from panelspark.session import new_name
from panelspark.sources import tables


def test_replaced_table_is_seen_whole_by_other_sessions(spark):
    name, other = new_name("shared"), spark.newSession()
    tables.replace_table(spark.range(10), name)
    reader = other.table(name)
    assert other.sql(f"SELECT count(*) AS n FROM {name}").first().n == 10
    tables.replace_table_as(spark.table(name), name, "SELECT id + 100 AS id, 'x' AS more FROM {df} WHERE id < 4")
    # who has begun reads the old rows, who begins now the new ones, columns included
    assert sorted(r.id for r in reader.collect()) == list(range(10))
    assert sorted(map(tuple, other.table(name).collect())) == [(100 + i, "x") for i in range(4)]
    with pytest.raises(Exception):
        tables.replace_table(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), name)
    assert other.table(name).count() == 4
    for i in range(3):
        tables.replace_table(spark.range(i + 1), name)
    assert other.table(name).count() == 3 and len(tables._versions(spark, name)) <= 2
    tables.drop_table(spark, name)
    assert not spark.catalog.tableExists(name) and tables._versions(spark, name) == []


def test_windows_over_buckets_need_no_exchange(spark):
    draw = random.Random(2)
    rows = [(c, h, y, draw.random()) for c in "ABCDEF" for h in "xyz" for y in range(2000, 2020)]
    df = spark.createDataFrame(rows, "country string, heading string, year int, v double")
    by = ["country", "heading"]
    stored = tables.write_bucketed(df, new_name("bucketed"), by, ["year"], 4)

    def built(source):
        found = series.lags(source, "v", by, "year")
        return found.withColumn("z", series.zscore_over("v", by))

    found = built(stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert found.exceptAll(built(df).select(found.columns)).count() == 0 and found.count() == len(rows)
    grouped = stored.groupBy(*by).agg(F.max("v"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
