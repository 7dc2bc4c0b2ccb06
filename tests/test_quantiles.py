"""Exact quantiles against sorting on the driver."""

import numpy as np
import pytest

from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.thresholds import contamination_threshold, flag_below

QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


def _samples():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(0, 1000, 3000),
        "tails": np.exp(rng.normal(0, 20, 2000)) * rng.choice([-1, 1], 2000),
        "hot": np.concatenate([np.full(1500, 3.25), rng.normal(3.25, 1e-6, 1500), np.zeros(700)]),
        "close": 1.0 + np.arange(500) * np.finfo(float).eps,
        "tiny": np.array([5e-324, 1e-310, 0.0, -0.0, -1e-320, 1e308, -1e308]),
        "one": np.array([4.5]),
    }


def _frame(spark, values):
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    return spark.createDataFrame(rows, "x double").repartition(5)


@pytest.mark.parametrize("name", list(_samples()))
def test_quantiles_match_sorting(spark, name):
    values = np.sort(_samples()[name])
    df = _frame(spark, values)
    n = len(values)
    disc = {r.q: r.value for r in exact_quantiles(df, "x", QS).collect()}
    cont = {r.q: r.value for r in exact_quantiles(df, "x", QS, True).collect()}
    assert set(disc) == set(cont) == set(QS)
    for q in QS:
        assert disc[q] == values[max(int(n - np.floor(n - q * n)), 1) - 1]
        at = (n - 1) * q
        low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
        share = at - np.floor(at)
        assert cont[q] == pytest.approx(low * (1 - share) + high * share, rel=1e-12, abs=5e-324)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).count() == 0
    assert contamination_threshold(df, "x").count() == 0


def test_infinities_have_their_place(spark):
    df = _frame(spark, [float("-inf"), *range(50), float("inf"), float("inf")])
    disc = {r.q: r.value for r in exact_quantiles(df, "x", [0.0, 0.5, 1.0]).collect()}
    assert disc == {0.0: float("-inf"), 0.5: 25.0, 1.0: float("inf")}
    cont = {r.q: r.value for r in exact_quantiles(df, "x", [0.5, 0.97], True).collect()}
    assert cont == {0.5: 25.0, 0.97: float("inf")}


def test_flag_below_is_strict_and_skips_missing(spark):
    df = _frame(spark, np.arange(101, dtype=float))
    flags = {r.x: r.f for r in flag_below(df.where("NOT isnan(x) OR x IS NULL"), "x", "f", 0.05).collect()}
    assert {x for x, f in flags.items() if f} == {0.0, 1.0, 2.0, 3.0, 4.0}
    assert flags[None] == 0
