"""Flagging the lowest share of a score."""

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.quantiles import exact_quantiles


def contamination_threshold(
    df: DataFrame, score: str, q: float = 0.05, accuracy: int | None = None
) -> DataFrame:
    """One row: the ``q`` quantile of the score, linearly interpolated.

    Exact unless the ``accuracy`` of an approximate sketch is given.
    """
    if accuracy is not None:
        return df.agg(F.percentile_approx(score, q, accuracy).alias("threshold"))
    return exact_quantiles(df, score, [q], interpolate=True).select(
        F.col("value").alias("threshold")
    )


def flag_below(
    df: DataFrame, score: str, flag: str, q: float = 0.05, accuracy: int | None = None
) -> DataFrame:
    """Flag 1 where the score is below the threshold; a missing score is not flagged."""
    threshold = contamination_threshold(df, score, q, accuracy).scalar()
    return df.withColumn(flag, F.when(F.col(score) < threshold, 1).otherwise(0))
