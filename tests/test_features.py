"""The feature table on hand tables, one case per semantic trap."""

import pytest

from panelspark.operators.aggregates import pivot_revenue, total_receipts
from panelspark.operators.ranking import method_comparison, ranked_anomalies, top_k_scores
from panelspark.plans import anomalies
from panelspark.plans.features import build_features
from panelspark.schemas import EXPENDITURE, FEATURES, NET_POSITION, REVENUE


def _exp(spark, rows):
    """Rows (year, country, heading, actual, earmarked, flag)."""
    full = [
        (y, c, h, h, float(a), float(e), f, int(y == 2024), i)
        for i, (y, c, h, a, e, f) in enumerate(rows)
    ]
    return spark.createDataFrame(full, EXPENDITURE)


def _rev(spark, rows):
    full = [(y, c, m, None if v is None else float(v), i) for i, (y, c, m, v) in enumerate(rows)]
    return spark.createDataFrame(full, REVENUE)


def _features(spark, exp, rev=(), **kw):
    found = build_features(_exp(spark, exp), _rev(spark, rev), **kw)
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in FEATURES]
    return {(r.year, r.country, r.heading): r for r in found.collect()}


def test_flagged_row_taints_heading_but_not_receipts(spark):
    exp = [(2020, "PL", "Core", 3, 3, 0), (2021, "PL", "Core", 10, 10, 0), (2021, "PL", "Core", 5, 5, 1)]
    rows = _features(spark, exp)
    row = rows[2021, "PL", "Core"]
    assert (row.actual_meur, row.is_ngeu, row.receipts_meur) == (15.0, 1, 10.0)
    kept = anomalies.h3_working_set(build_features(_exp(spark, exp), _rev(spark, [])))
    assert kept.count() == 0
    receipts = total_receipts(_exp(spark, exp)).where("year = 2021").first()
    assert receipts.receipts_meur == 10.0


def test_only_flagged_rows_give_no_receipts(spark):
    row = _features(spark, [(2021, "PL", "Core", 5, 5, 1)])[2021, "PL", "Core"]
    assert row.receipts_meur is None and row.net_position_meur is None


def test_row_wide_earmark(spark):
    rows = _features(spark, [(2010, "A", "x", 30, 100, 0), (2010, "B", "x", 50, 100, 0)])
    assert rows[2010, "A", "x"].absorption_rate_pct == 30.0
    assert rows[2010, "B", "x"].absorption_rate_pct == 50.0
    assert rows[2010, "A", "x"].absorption_gap_meur == 70.0


def test_net_position_and_zero_denominators(spark):
    rev = [(2010, "A", "total_contributions", 7), (2010, "A", "gni_size", 200),
           (2010, "B", "total_contributions", 1), (2010, "B", "gni_size", 0)]
    rows = _features(spark, [(2010, "A", "x", 12, 0, 0), (2010, "B", "x", 2, 4, 0)], rev)
    a, b = rows[2010, "A", "x"], rows[2010, "B", "x"]
    assert (a.net_position_meur, a.net_pct_gni, a.absorption_rate_pct) == (5.0, 2.5, None)
    assert (b.net_position_meur, b.net_pct_gni, b.zscore_net) == (1.0, None, None)
    assert a.year_index == 10


@pytest.mark.parametrize("chunk", [None, 2])
def test_z_score_weights_years_by_headings(spark, chunk):
    exp = [(2001, "A", h, 100, 90, 0) for h in "xyz"] + [(2002, "A", "x", 500, 90, 0)]
    rev = [(y, "A", m, v) for y in (2001, 2002) for m, v in (("total_contributions", 100), ("gni_size", 1000))]
    rows = _features(spark, exp, rev, chunk=chunk)
    # 2001: (300-100)/1000 = 20 % three times; 2002: (500-100)/1000 = 40 % once.
    values = [20.0, 20.0, 20.0, 40.0]
    mean = sum(values) / 4
    std = (sum((v - mean) ** 2 for v in values) / 3) ** 0.5
    assert rows[2001, "A", "y"].zscore_net == round((20 - mean) / std, 3)
    assert rows[2002, "A", "x"].zscore_net == round((40 - mean) / std, 3)
    assert rows[2002, "A", "x"].lag1 == 100.0 and rows[2001, "A", "x"].lag1 is None


def test_constant_net_position_has_no_z_score(spark):
    exp = [(y, "A", "x", 0.3, 1, 0) for y in (2001, 2002, 2003)]
    rev = [(y, "A", m, v) for y in (2001, 2002, 2003) for m, v in (("total_contributions", 0.1), ("gni_size", 7))]
    rows = _features(spark, exp, rev)
    assert all(r.zscore_net is None and r.zscore_absorption is None for r in rows.values())
    h1 = anomalies.net_positions(build_features(_exp(spark, exp), _rev(spark, rev)))
    assert [f.name for f in h1.schema] == [f.name for f in NET_POSITION]
    assert [r.h1_anomaly for r in h1.collect()] == [0, 0, 0]
    assert h1.where("year = 2002").first().net_position_change == 0.0


def test_first_non_null_value_wins(spark):
    rev = [(2010, "A", "customs", None), (2010, "A", "customs", 4), (2010, "A", "customs", 9)]
    row = pivot_revenue(_rev(spark, rev)).first()
    assert row.customs == 4.0 and row.total_expenditure is None


def test_fills(spark):
    exp = [(2001, "A", "x", 5, 0, 0), (2002, "A", "x", 6, 0, 0)]
    found = build_features(_exp(spark, exp), _rev(spark, []))
    row = anomalies.absorption_set(found).first()
    assert row.absorption_rate_pct == 0.0 and row.lag2 is None and row.lag1 == 5.0
    from panelspark.operators.matrix import feature_matrix

    matrix = feature_matrix(found, anomalies.MODEL_COLS, ["year"]).where("year = 2001").first()
    assert (matrix.absorption_rate_pct, matrix.lag1, matrix.roll_mean_3) == (0.0, 0.0, 0.0)


def test_agreement_and_precision(spark):
    pairs = [(1, 1)] * 2 + [(1, 0)] * 2 + [(0, 1)] * 6 + [(0, 0)] * 10
    df = spark.createDataFrame(pairs, "a int, b int")
    row = method_comparison(df, "a", "b").first()
    assert (row.n_total, row.n_a, row.n_b, row.n_both) == (20, 4, 8, 2)
    assert (row.agreement_of_larger_pct, row.agreement_rate_pct, row.precision_pct) == (25.0, 50.0, 50.0)
    none = method_comparison(df.where("a = 0 AND b = 0"), "a", "b").first()
    assert (none.agreement_rate_pct, none.precision_pct, none.agreement_of_larger_pct) == (0.0, 0.0, None)


def test_lowest_score_ranks_first(spark):
    rows = [("A", "x", 1, -0.5, 1), ("B", "x", 1, -0.7, 1), ("C", "x", 1, -0.4, 1), ("D", "x", 1, -0.9, 0)]
    df = spark.createDataFrame(rows, "country string, heading string, year int, s double, f int")
    assert [r.s for r in ranked_anomalies(df, "f", "s").collect()] == [-0.7, -0.5, -0.4]
    assert top_k_scores(df, "s", 1, ascending=False).first().s == -0.4
