"""The whole run in one call: from cells to the six outputs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.crosswalk import HEADING_RULES, METRIC_RULES, Rules
from panelspark.functions.labels import COUNTRIES
from panelspark.operators.audit import profile_scan
from panelspark.operators.ranking import ranked_anomalies
from panelspark.plans import anomalies, documents
from panelspark.plans.features import build_features
from panelspark.plans.ingest import parse_sheets
from panelspark.session import materialize
from panelspark.sources import sinks

RANKED = [
    "year",
    "country",
    "heading",
    "absorption_gap_meur",
    "absorption_rate_pct",
    "if_score",
    "lof_anomaly",
    "lof_score",
]


def ranked_table(scored: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most abnormal rows of the forest, with the outlier factor beside it."""
    return ranked_anomalies(scored, "if_anomaly", "if_score", n).select(*RANKED)


def run_pipeline(
    cells: DataFrame,
    out: str,
    entities: Sequence[str] = COUNTRIES,
    heading_rules: Rules = HEADING_RULES,
    metric_rules: Rules = METRIC_RULES,
    keys: Sequence[str] = ("BE", "DE", "Total"),
    preliminary_year: int = 2024,
    base_year: int = 2000,
    period: str = "2000-2024",
    threshold: float = 2.0,
    trees: int = 100,
    neighbours: int = 20,
    contamination: float = 0.05,
    seed: int = 42,
    top: int = 30,
    digits: int | None = None,
    stamp: Column | None = None,
) -> dict[str, DataFrame]:
    """Parse, audit, build features, look for anomalies; write all six outputs below ``out``.

    features and scores go to Parquet, h1 and ranked to CSV, audit and summary to JSON.
    Returns the stored tables by the name of their output.
    """
    spark = cells.sparkSession
    raw, income = parse_sheets(
        cells, entities, heading_rules, metric_rules, keys, preliminary_year=preliminary_year
    )
    # the audit's counts are taken while the parsed table is written
    scan = profile_scan(raw, "actual_meur", digits=digits, whole=True)
    raw = scan.stored
    document = documents.audit_document(raw, stamp=stamp, period=period, digits=digits, scan=scan)
    audit = materialize(document, "audit")
    sinks.write_document(audit, f"{out}/audit")

    features = build_features(raw, income, base_year, digits=digits)
    sinks.write_sorted(features, f"{out}/features", ["country", "heading", "year"])
    features = spark.read.schema(features.schema).parquet(f"{out}/features")

    h1 = materialize(anomalies.net_positions(features, threshold), "h1")
    sinks.write_table(h1, f"{out}/h1", "csv")

    scored = anomalies.absorption_anomalies(features, trees, neighbours, contamination, seed)
    sinks.write_table(scored, f"{out}/scores")
    scored = spark.read.schema(scored.schema).parquet(f"{out}/scores")
    ranked = materialize(ranked_table(scored, top), "ranked")
    sinks.write_table(ranked, f"{out}/ranked", "csv")

    score = audit.select(F.col("quality_scores.overall").alias("overall"))
    summary = materialize(documents.run_summary(features, h1, scored, score, stamp), "summary")
    sinks.write_document(summary, f"{out}/summary")
    return {
        "features": features,
        "scores": scored,
        "h1": h1,
        "ranked": ranked,
        "audit": audit,
        "summary": summary,
    }
