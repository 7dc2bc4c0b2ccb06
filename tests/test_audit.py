"""Profiles, the quality score and the two documents."""

import json

import pytest
from pyspark.sql import functions as F

from panelspark.operators import audit
from panelspark.plans.documents import audit_document, run_summary
from panelspark.schemas import EXPENDITURE
from panelspark.session import materialize, new_path
from panelspark.sources.sinks import write_document


@pytest.fixture(scope="module")
def exp(spark):
    rows = [
        (2000 + i % 25, "ABC"[i % 3], "raw", None if i < 2 else "Core", float(i), 100.0, 0, 0, i)
        for i in range(49)
    ]
    rows += [(2024, "A", "raw", "Core", 10_000.0, 100.0, 0, 0, 49), rows[-1]]
    return materialize(spark.createDataFrame(rows, EXPENDITURE), "exp")


def test_null_and_duplicate_profile(exp):
    nulls = {r.column_name: r for r in audit.null_profile(exp).collect()}
    assert list(nulls) == exp.columns
    assert (nulls["heading"].null_count, nulls["heading"].null_pct) == (2, 3.92)
    assert nulls["heading"].status == "OK"
    assert audit.null_profile(exp, 3.0).where("column_name = 'heading'").first().status == "WARNING"
    copies = audit.duplicate_profile(exp).first()
    assert tuple(copies) == (51, 50, 1, 1.96, "Review")
    empty = audit.duplicate_profile(exp.where("year < 0")).first()
    assert tuple(empty) == (0, 0, 0, 0.0, "OK")


def test_outliers(exp):
    row = audit.iqr_outliers(exp, "actual_meur").first()
    # 51 values: 0..48 with 48 twice, and 10000.
    assert (row.q25, row.median, row.q75, row.iqr) == (12.0, 25.0, 38.0, 26.0)
    assert (row.lower_bound, row.upper_bound, row.outlier_count) == (-66.0, 116.0, 1)
    assert row.outlier_pct == 100.0 / 51
    near = audit.amount_stats(exp, "actual_meur", accuracy=10_000).first()
    assert (near["min"], near["max"]) == (0.0, 10_000.0) and abs(near.median - 25.0) <= 1.0
    assert audit.range_outliers(exp, "actual_meur", F.lit(1.0), F.lit(47.0)).count() == 4


def _score(spark, nulls, outlier_pct, duplicates, year):
    null_p = spark.createDataFrame([("c", n) for n in nulls], "column_name string, null_pct double")
    dup_p = spark.createDataFrame([(100, duplicates)], "total long, duplicate_count long")
    out_p = spark.createDataFrame([(outlier_pct,)], "outlier_pct double")
    latest = spark.createDataFrame([(year,)], "max_year int")
    return tuple(audit.quality_score(null_p, dup_p, out_p, latest).first())


def test_quality_score(spark):
    assert _score(spark, [0.0, 0.0], 4.0, 2, 2024) == (100.0, 98.0, 98.0, 100.0, 99.0, "EXCELLENT")
    assert _score(spark, [10.0, 0.0], 20.0, 20, 2022)[-2:] == (88.8, "GOOD")
    assert _score(spark, [90.0, 90.0], 50.0, 50, 2022)[-1] == "NEEDS IMPROVEMENT"


def test_constraints(spark):
    schema = (
        "year int, country string, heading string, actual_meur double, earmarked_meur double, "
        "absorption_rate_pct double, net_pct_gni double"
    )
    rows = [
        (1999, "XX", None, -1.0, -1.0, 130.0, 6.0),
        (2010, "DE", "x", 1.0, 1.0, 110.0, None),
        (2010, "DE", "x", 1.0, 1.0, None, -10.0),
    ]
    rules = audit.standard_rules(["DE"])
    got = {r.rule: r.violations for r in audit.constraint_checks(spark.createDataFrame(rows, schema), rules).collect()}
    assert list(got) == [name for name, _ in rules]
    assert list(got.values()) == [1, 1, 1, 1, 1, 1, 2, 1]


def _read_document(spark, df):
    path = new_path(spark, "document")
    write_document(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 1
    return json.loads(lines[0])


def test_documents(spark, exp):
    found = _read_document(spark, audit_document(exp))
    assert list(found) == [
        "timestamp", "pipeline_version", "data_period", "missing_values", "duplicates", "outliers", "quality_scores"]
    assert found["missing_values"]["heading"] == {"count": 2, "pct": 3.92, "status": "OK"}
    assert set(found["outliers"]) == {"mean", "median", "std", "min", "max", "iqr", "outlier_count", "outlier_pct"}
    assert found["quality_scores"]["timeliness"] == 100.0

    features = spark.range(5)
    h1 = spark.createDataFrame([("A", 1), ("A", 0), ("B", 0)], "country string, h1_anomaly int")
    flags = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "if_anomaly int, lof_anomaly int")
    score = spark.createDataFrame([(97.9,)], "overall double")
    summary = _read_document(spark, run_summary(features, h1, flags, score))
    del summary["timestamp"]
    assert summary == {
        "feature_rows": 5, "h1_country_years": 3, "h1_anomalies": 1, "h3_rows_scored": 3,
        "h3_if_anomalies": 1, "h3_lof_anomalies": 2, "h3_both_agree": 1, "agreement_rate_pct": 100.0,
        "precision_if_vs_lof": 100.0, "baseline_method": "Local Outlier Factor (LOF)",
        "overall_quality_score": 97.9}
