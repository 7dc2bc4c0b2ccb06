"""Model inputs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def filled(cols: Sequence[str]) -> list[Column]:
    """The columns as doubles, missing values as 0.0.  Nothing is scaled."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]


def feature_matrix(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model columns without missing values, next to the columns in ``keep``."""
    return df.select(*keep, *[v.alias(c) for c, v in zip(cols, filled(cols))])
