"""The feature table: heading level, entity level, series features, z-scores."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.exprs import (
    absorption_gap,
    absorption_rate,
    exact_sum_decimal,
    net_pct_gni,
    net_position,
    round_mul,
    safe_ratio,
    total_of,
    year_index,
)
from panelspark.operators.aggregates import pivot_revenue
from panelspark.operators.series import attach, lags, mean_of, zscore, zscore_over
from panelspark.schemas import FEATURES
from panelspark.session import materialize

SERIES = ("country", "heading")


def heading_base(exp: DataFrame, digits: int | None = None) -> DataFrame:
    """Everything the raw rows are needed for, in one scan and one shuffle.

    Next to the heading sums it keeps the part of the sum that counts as receipts,
    so receipts need no second pass over the raw rows.  ``digits`` are the decimals of
    the amounts: with them all sums are exact.
    """
    counted = F.when(F.col("is_ngeu") == 0, F.col("actual_meur"))
    receipts = F.sum(counted.cast("double")) if digits is None else exact_sum_decimal(counted, digits)
    return exp.groupBy("year", *SERIES).agg(
        total_of("actual_meur", digits).alias("actual_meur"),
        total_of("earmarked_meur", digits).alias("earmarked_meur"),
        F.max("is_ngeu").alias("is_ngeu"),
        F.max("is_preliminary").alias("is_preliminary"),
        receipts.alias("_receipts"),
    )


def _per_country(df: DataFrame, measures: dict[str, Column], in_window: bool) -> DataFrame:
    """Add aggregates per country: over a window, or grouped and joined back."""
    if in_window:
        country = Window.partitionBy("country")
        return df.withColumns({name: agg.over(country) for name, agg in measures.items()})
    stats = df.groupBy("country").agg(*[agg.alias(name) for name, agg in measures.items()])
    return attach(df, stats, ["country"])


def entity_level(headings: DataFrame, rev_wide: DataFrame, in_window: bool = True) -> DataFrame:
    """One row per (year, country): receipts, contributions, net position, z-score.

    The z-score of the net position averages over heading rows, so each year is
    weighted by its number of headings.  Done here, a country has one row per year
    and fits a window; on heading rows it would be one large group.  With fine
    periods pass ``in_window=False``.
    """
    receipts = headings.groupBy("year", "country").agg(
        F.sum("_receipts").cast("double").alias("receipts_meur"),
        F.count("*").alias("_weight"),
    )
    revenue = rev_wide.select("year", "country", "total_contributions", "gni_size")
    measured = receipts.join(revenue, ["year", "country"], "left").withColumns(
        {
            "net_pct_gni": net_pct_gni("receipts_meur", "total_contributions", "gni_size"),
            "net_position_meur": net_position("receipts_meur", "total_contributions"),
        }
    )
    if not in_window:
        measured = materialize(measured, "entities")
    x = F.col("net_pct_gni")
    w = F.when(x.isNotNull(), F.col("_weight"))
    # The rounded percentages are decimals, so the weighted sum is exact.
    weighted = F.sum(x.cast("decimal(22,4)") * w.cast("decimal(12,0)"))
    sums = {"_n": F.sum(w), "_sum": weighted, "_low": F.min(x), "_high": F.max(x)}
    known = _per_country(measured, sums, in_window)
    known = known.withColumn("_mean", safe_ratio("_sum", "_n"))
    gap = x - F.col("_mean")
    known = _per_country(known, {"_squares": F.sum(w * gap * gap)}, in_window)
    std = F.when(F.col("_high") > F.col("_low"), F.sqrt(safe_ratio("_squares", F.col("_n") - 1)))
    z = round_mul(safe_ratio(gap, std), 3)
    helpers = ["_weight", "_n", "_sum", "_low", "_high", "_mean", "_squares"]
    return known.withColumn("zscore_net", z).drop(*helpers)


def series_level(
    headings: DataFrame, base_year: int, chunk: int | None, digits: int | None = None
) -> DataFrame:
    """Absorption, earlier values and the z-score of the gap, per (country, heading).

    All of it needs the heading columns only, so it comes before the entity columns
    are joined: the one shuffle carries narrow rows.
    """
    series = lags(headings, "actual_meur", SERIES, "year", 3, chunk=chunk).withColumns(
        {
            "absorption_gap_meur": absorption_gap("earmarked_meur", "actual_meur"),
            "absorption_rate_pct": absorption_rate("actual_meur", "earmarked_meur"),
            "year_index": year_index("year", base_year),
            "yoy_change": round_mul(F.col("actual_meur") - F.col("lag1"), 2),
            "roll_mean_3": mean_of(["lag1", "lag2", "lag3"], decimals=digits),
        }
    )
    if chunk is None:
        z = zscore_over("absorption_gap_meur", SERIES)
        return series.withColumn("zscore_absorption", z)
    stored = materialize(series, "series")
    return zscore(stored, "absorption_gap_meur", SERIES, "zscore_absorption")


def build_features(
    exp: DataFrame,
    rev: DataFrame,
    base_year: int = 2000,
    chunk: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """The 22-column feature table, one row per (year, country, heading).

    The heading level is written down once: the raw rows are scanned once, and
    both the entity level and the series features read the small result.  ``chunk``
    splits long series, see ``operators.series``; ``digits`` are the decimals of the
    amounts and make their sums exact.
    """
    headings = materialize(heading_base(exp, digits), "headings")
    entities = entity_level(headings, pivot_revenue(rev), in_window=chunk is None)
    series = series_level(headings.drop("_receipts"), base_year, chunk, digits)
    found = series.join(entities, ["year", "country"], "left")
    return found.select(*[F.col(f.name).cast(f.dataType) for f in FEATURES.fields])
