"""Merged quantile sketches against exact ranks."""

import numpy as np
import pytest

from panelspark.operators import sketches

QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@pytest.mark.parametrize("kind", ["even", "skewed", "ties"])
def test_rank_error_stays_within_the_bound(spark, kind):
    rng = np.random.default_rng(8)
    n = 60_000
    values = np.exp(rng.normal(0, 2, n)) if kind != "ties" else rng.integers(0, 40, n).astype(float)
    # the skewed years: one holds nearly all rows, and its values are its own
    years = rng.integers(2000, 2025, n) if kind == "even" else np.where(rng.random(n) < 0.9, 2000, 2001 + rng.integers(0, 9, n))
    if kind == "skewed":
        values = values + (years - 2000) * 50.0
    rows = [(int(y), float(v)) for y, v in zip(years, values)] + [(2000, None), (1999, None), (2000, float("nan"))]
    stored = sketches.period_sketches(spark.createDataFrame(rows, "year int, v double").repartition(5), "v")
    assert {r.year for r in stored.collect()} == set(years.tolist())
    ordered = np.sort(values)
    for r in sketches.merged_quantiles(stored, QS).collect():
        low, high = (np.searchsorted(ordered, r.value, side) / n for side in ("left", "right"))
        assert low - sketches.rank_error() <= r.q <= high + sketches.rank_error()
    # a new year is added without the rows of the others
    part = sketches.merged_quantiles(stored.where("year > 2000"), [0.5]).first()
    rest = np.sort(values[years > 2000])
    assert abs(np.searchsorted(rest, part.value) / len(rest) - 0.5) <= sketches.rank_error() + (0.05 if kind == "ties" else 0)
    row = sketches.sketched_stats(stored).first()
    assert row.q25 <= row.median <= row.q75
    assert sketches.sketched_threshold(stored, 0.05).first().threshold <= row.q25


def test_no_rows(spark):
    stored = sketches.period_sketches(spark.createDataFrame([(1, None)], "year int, v double"), "v")
    assert stored.count() == 0 and sketches.merged_quantiles(stored, QS).count() == 0
    assert sketches.sketched_stats(stored).first().median is None
