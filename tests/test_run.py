"""The whole run, from the cell grid of the smallest tables to its six outputs."""

from pyspark.sql import functions as F

from panelspark.plans.run import RANKED, run_pipeline
from panelspark.session import new_path
from panelspark.sources import driver_tables as tables

FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    out = new_path(spark, "run")
    found = run_pipeline(
        tables.cells(spark, FOLDER),
        out,
        tables.NATIONS,
        tables.HEADING_RULES,
        keys=tables.HEADER_KEYS,
        preliminary_year=tables.PRELIMINARY_YEAR,
        period="1995-2001",
        trees=20,
        digits=tables.DIGITS,
        stamp=F.lit("fixed"),
    )
    assert set(found) == {"features", "scores", "h1", "ranked", "audit", "summary"}
    scores = found["scores"].toPandas()
    flagged = scores[scores.if_anomaly == 1].sort_values(["if_score", "country", "heading", "year"])
    ranked = spark.read.option("header", True).csv(f"{out}/ranked")
    assert ranked.columns == RANKED
    assert {(r.country, r.heading, int(r.year)) for r in ranked.collect()} == {
        (r.country, r.heading, r.year) for r in flagged.head(30).itertuples()
    }
    summary = spark.read.json(f"{out}/summary").first()
    assert summary.feature_rows == spark.read.parquet(f"{out}/features").count() > 0
    assert summary.h3_rows_scored == len(scores)
    assert summary.h3_if_anomalies == len(flagged) > 0
    assert summary.h3_lof_anomalies == int(scores.lof_anomaly.sum())
    assert summary.h3_both_agree == int((flagged.lof_anomaly == 1).sum())
    assert summary.h1_country_years == spark.read.option("header", True).csv(f"{out}/h1").count()
    audit = spark.read.json(f"{out}/audit").first()
    assert audit.timestamp == summary.timestamp == "fixed"
    assert audit.missing_values.actual_meur["count"] == 0
    assert audit.quality_scores.overall == summary.overall_quality_score
