"""The tables behind the charts; drawing is left to the reader of the tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.exprs import scale_to_bn
from panelspark.functions.labels import (
    BUDGET_PERIODS,
    CHRONIC_COUNTRIES,
    DRIFT_COUNTRIES,
    POLICY_EVENTS,
    anomaly_label,
    mff_period,
    net_status,
    policy_event,
)
from panelspark.operators.aggregates import count_by, mean_by, period_grid, sum_flag_by
from panelspark.operators.ranking import KEYS, entity_subset, latest_period, top_k_scores


def rows_by_year(df: DataFrame, periods=BUDGET_PERIODS) -> DataFrame:
    """Rows per year, with the budget period the year belongs to."""
    return count_by(df, "year").withColumn("mff_period", mff_period("year", periods))


def rows_by_entity_year(df: DataFrame, years: Sequence[int]) -> DataFrame:
    return period_grid(df, "country", "year", years)


def net_drift_series(h1: DataFrame, members: Sequence[str] = DRIFT_COUNTRIES) -> DataFrame:
    """Net position in billions over the years for a few countries."""
    return entity_subset(h1, members).select(
        "country", "year", scale_to_bn("net_position_meur").alias("net_position_bn")
    )


def net_position_ranking(h1: DataFrame) -> DataFrame:
    """Countries in the last year; sort by net_position_bn to draw."""
    return latest_period(h1).select(
        "country",
        "year",
        scale_to_bn("net_position_meur").alias("net_position_bn"),
        net_status("net_position_meur").alias("net_status"),
    )


def anomaly_grid(scored: DataFrame, flag: str, years: Sequence[int]) -> DataFrame:
    return period_grid(scored, "country", "year", years, value=flag)


def mean_rate_by_heading(scored: DataFrame, digits: int | None = None) -> DataFrame:
    return mean_by(scored, "heading", "absorption_rate_pct", "mean_rate_pct", digits)


def top_anomalies(
    scored: DataFrame, score: str, n: int = 10, ascending: bool = True
) -> DataFrame:
    """The ``n`` most abnormal rows with the label the chart shows; descending, the most normal."""
    best = top_k_scores(scored, score, n, ascending)
    return best.select(*KEYS, score, anomaly_label("country", "year", "heading").alias("label"))


def policy_timeline(scored: DataFrame, flag: str, events=POLICY_EVENTS) -> DataFrame:
    """Anomalies per year, with the event of the year."""
    counts = sum_flag_by(scored, flag, "year")
    return counts.withColumn("policy_event", policy_event("year", events))


def chronic_points(
    scored: DataFrame, flag: str, members: Sequence[str] = CHRONIC_COUNTRIES
) -> DataFrame:
    """Rates of a few countries, each row marked as anomaly or normal."""
    mark = F.when(F.col(flag) == 1, "anomaly").otherwise("normal").alias("mark")
    return entity_subset(scored, members).select(
        "country", "year", "heading", "absorption_rate_pct", mark
    )
