"""Quantile sketches kept per period and merged, instead of scanning the rows again."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelspark.session import materialize

#: Size parameter of the sketches; the rank error shrinks with it.
K = 400


def rank_error(k: int = K) -> float:
    """Bound on the error of a single rank at 99 %, as published for KLL sketches."""
    return 2.296 / k**0.9021


def period_sketches(df: DataFrame, value: str, period: str = "year", k: int = K) -> DataFrame:
    """(period, n, sketch), stored: one scan, whose partial sketches merge before the shuffle.

    NULL and NaN are left out.  A new period is a row more; nothing else is read again.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    sketch = F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch")
    return materialize(rows.groupBy(period).agg(F.count("*").alias("n"), sketch), "sketches")


def merged_quantiles(sketches: DataFrame, qs: Sequence[float], k: int = K) -> DataFrame:
    """(q, value) over all rows of ``period_sketches``, or of those of them that are given."""
    merged = sketches.agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.count("*").alias("n"))
    entries = [
        F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value"))
        for q in qs
    ]
    return merged.where("n > 0").select(F.inline(F.array(*entries)))


def sketched_stats(sketches: DataFrame, k: int = K) -> DataFrame:
    """One row (q25, median, q75), like the exact quartiles."""
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    found = merged_quantiles(sketches, list(names.values()), k)
    return found.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in names.items()])


def sketched_threshold(sketches: DataFrame, q: float = 0.05, k: int = K) -> DataFrame:
    """One row: the score below which about the share ``q`` lies."""
    return merged_quantiles(sketches, [q], k).select(F.col("value").alias("threshold"))
