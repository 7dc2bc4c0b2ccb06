"""Labels from a table of intervals."""

import random

import pytest

from panelspark.operators.intervals import interval_label

BANDS = "start double, end double, label string, ordinal int"


def _label(v, bands, closed):
    found = [
        (o, name)
        for a, b, name, o in bands
        if v is not None and (a is None or v >= a) and (b is None or v < b or (v == b and closed == "both"))
    ]
    return min(found)[1] if found else None


@pytest.mark.parametrize("closed", ["both", "left"])
def test_overlaps_gaps_and_open_ends(spark, closed):
    draw = random.Random(3)
    bands = [(float(a), float(a + draw.choice((0, 1, 7, 400))), f"b{i}", draw.randrange(50)) for i, a in enumerate(draw.choices(range(0, 900), k=120))]
    bands += [(None, -5.0, "low", 1), (1500.0, None, "high", 0), (None, None, "any", 99 if closed == "both" else 1)]
    values = [None, -5.0, -9.5, 0.0, 2000.0] + [draw.uniform(-20, 1600) for _ in range(200)] + [float(x) for x in range(0, 900, 9)]
    values += [values[7]] * 50
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    found = interval_label(df, "v", spark.createDataFrame(bands, BANDS), "name", closed).collect()
    assert len(found) == len(values)
    assert {r.id: r.name for r in found} == {i: _label(v, bands, closed) for i, v in enumerate(values)}


def test_nothing_outside_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "id int, v double")
    none = spark.createDataFrame([], BANDS)
    assert [r.name for r in interval_label(df, "v", none, "name").collect()] == [None, None]
    one = spark.createDataFrame([(6.0, 7.0, "x", 1)], BANDS)
    assert [r.name for r in interval_label(df, "v", one, "name").collect()] == [None, None]
    assert interval_label(df.where("id > 5"), "v", one, "name").count() == 0
    with pytest.raises(ValueError):
        interval_label(df, "v", one, "name", closed="right")


def test_many_intervals_without_a_nested_loop(spark):
    bands = spark.range(10_000).selectExpr("id * 2.0D AS start", "id * 2.0D + 1.5D AS end", "cast(id AS string) AS label", "cast(id AS int) AS ordinal")
    df = spark.range(5_000).selectExpr("id", "cast(id * 3.7D AS double) AS v")
    found = interval_label(df, "v", bands, "name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for r in found.collect():
        k = int(r.v // 2)
        assert r.name == (str(k) if r.v - 2 * k <= 1.5 else None)
