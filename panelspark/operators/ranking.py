"""Filters, fills, rankings and comparisons around anomaly scores."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.exprs import percent_of, round_mul

KEYS = ("country", "heading", "year")


def project_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def entity_subset(df: DataFrame, members: Sequence, entity: str = "country") -> DataFrame:
    return df.where(F.col(entity).isin(*members))


def latest_period(df: DataFrame, period: str = "year") -> DataFrame:
    """Rows of the last period, found first and pushed into the scan as a value."""
    return df.where(F.col(period) == df.agg(F.max(period)).scalar())


def flag_split(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """The rows with and without the flag."""
    return df.where(F.col(flag) == 1), df.where(F.col(flag) == 0)


def fill_constant(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return df.fillna(dict(fills))


def sort_by(df: DataFrame, *keys) -> DataFrame:
    """Total order by range partitioning; for the sink, never inside an operator."""
    return df.orderBy(*keys)


def top_k_scores(
    df: DataFrame,
    score: str,
    n: int = 10,
    ascending: bool = True,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """First ``n`` rows by score, ties by key.  The lowest score is the most abnormal."""
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.orderBy(order, *keys).limit(n)


def ranked_anomalies(
    df: DataFrame, flag: str, score: str, n: int = 30, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The ``n`` most abnormal flagged rows."""
    return top_k_scores(df.where(F.col(flag) == 1), score, n, True, keys)


def method_comparison(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: counts and shares of two flags, and how far they agree.

    Agreement is given against the larger count and against the first flag.
    """
    total = [
        F.count("*").alias("n_total"),
        F.count_if(F.col(a) == 1).alias("n_a"),
        F.count_if(F.col(b) == 1).alias("n_b"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("n_both"),
    ]
    both = F.col("n_both")
    return df.agg(*total).select(
        "n_total",
        "n_a",
        "n_b",
        "n_both",
        round_mul(percent_of("n_a", "n_total"), 1).alias("pct_a"),
        round_mul(percent_of("n_b", "n_total"), 1).alias("pct_b"),
        round_mul(percent_of(both, F.greatest("n_a", "n_b")), 1).alias("agreement_of_larger_pct"),
        round_mul(percent_of(both, F.greatest("n_a", F.lit(1))), 1).alias("agreement_rate_pct"),
        F.coalesce(round_mul(percent_of(both, "n_a"), 1), F.lit(0.0)).alias("precision_pct"),
    )
