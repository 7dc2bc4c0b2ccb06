"""The audit document and the run summary, one row each."""

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.exprs import format_now, round_mul
from panelspark.operators import audit
from panelspark.operators.ranking import method_comparison
from panelspark.plans.anomalies import h1_summary


def audit_profiles(
    exp: DataFrame,
    amount: str = "actual_meur",
    accuracy: int | None = None,
    digits: int | None = None,
    scan: audit.Scan | None = None,
):
    """Null, duplicate and outlier profile, and quality score.

    ``exp`` is read once, or not at all where a ``scan`` of it is given; what follows
    reads the narrow table of the scan.
    """
    scan = scan or audit.profile_scan(exp, amount, digits=digits)
    nulls = scan.null_profile()
    copies = scan.duplicate_profile()
    outliers = scan.iqr_outliers(accuracy=accuracy)
    score = audit.quality_score(nulls, copies, outliers, scan.max_period())
    return nulls, copies, outliers, score


def audit_document(
    exp: DataFrame,
    amount: str = "actual_meur",
    accuracy: int | None = None,
    stamp: Column | None = None,
    version: str = "1.0",
    period: str = "2000-2024",
    digits: int | None = None,
    scan: audit.Scan | None = None,
) -> DataFrame:
    """One row: profile sections as nested values, ready for ``write_document``."""
    nulls, copies, outliers, score = audit_profiles(exp, amount, accuracy, digits, scan)
    entry = F.struct(
        F.col("null_count").alias("count"), F.col("null_pct").alias("pct"), F.col("status")
    )
    missing = nulls.agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", entry))).alias("missing_values")
    )
    sections = {
        "mean": "mean",
        "median": "median",
        "std": "stddev",
        "min": "min",
        "max": "max",
        "iqr": "iqr",
    }
    rounded = [round_mul(c, 2).alias(name) for name, c in sections.items()]
    fences = outliers.select(
        F.struct(*rounded, "outlier_count", round_mul("outlier_pct", 2).alias("outlier_pct"))
        .alias("outliers")
    )
    duplicates = copies.select(F.struct(*copies.columns).alias("duplicates"))
    scores = score.select(F.struct(*score.columns).alias("quality_scores"))
    joined = audit.with_one_row(missing, duplicates, fences, scores)
    return joined.select(
        (format_now() if stamp is None else stamp).alias("timestamp"),
        F.lit(version).alias("pipeline_version"),
        F.lit(period).alias("data_period"),
        "missing_values",
        "duplicates",
        "outliers",
        "quality_scores",
    )


def run_summary(
    features: DataFrame,
    h1: DataFrame,
    scored: DataFrame,
    score: DataFrame,
    stamp: Column | None = None,
    a: str = "if_anomaly",
    b: str = "lof_anomaly",
    baseline: str = "Local Outlier Factor (LOF)",
) -> DataFrame:
    """One flat row over the stored results of a run."""
    joined = audit.with_one_row(
        features.agg(F.count("*").alias("feature_rows")),
        h1_summary(h1),
        method_comparison(scored, a, b),
        score.select("overall"),
    )
    return joined.select(
        (format_now() if stamp is None else stamp).alias("timestamp"),
        "feature_rows",
        F.col("country_years").alias("h1_country_years"),
        F.col("total_anomalies").alias("h1_anomalies"),
        F.col("n_total").alias("h3_rows_scored"),
        F.col("n_a").alias("h3_if_anomalies"),
        F.col("n_b").alias("h3_lof_anomalies"),
        F.col("n_both").alias("h3_both_agree"),
        "agreement_rate_pct",
        F.col("precision_pct").alias("precision_if_vs_lof"),
        F.lit(baseline).alias("baseline_method"),
        F.col("overall").alias("overall_quality_score"),
    )
