"""Grouped measures of a panel.  All aggregates combine partially before a shuffle."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.crosswalk import METRICS
from panelspark.functions.exprs import mean_of_rows, percent_of, total_of

HEADING_KEYS = ("year", "country", "heading")
ENTITY_KEYS = ("year", "country")


def heading_level(
    exp: DataFrame,
    keys: Sequence[str] = HEADING_KEYS,
    measures: Sequence[str] = ("actual_meur", "earmarked_meur"),
    flags: Sequence[str] = ("is_ngeu", "is_preliminary"),
    digits: int | None = None,
) -> DataFrame:
    """Sum the measures and take the maximum of the flags per key.

    With ``digits``, the decimals of the measures, sums are exact and order-free.
    """
    sums = [total_of(c, digits).alias(c) for c in measures]
    tops = [F.max(c).alias(c) for c in flags]
    return exp.groupBy(*keys).agg(*sums, *tops)


def exclude_flagged(df: DataFrame, flag: str = "is_ngeu") -> DataFrame:
    return df.where(F.col(flag) == 0)


def total_receipts(
    exp: DataFrame,
    keys: Sequence[str] = ENTITY_KEYS,
    flag: str = "is_ngeu",
    value: str = "actual_meur",
    out: str = "receipts_meur",
    digits: int | None = None,
) -> DataFrame:
    """Sum of the rows that do not carry the flag themselves."""
    return exclude_flagged(exp, flag).groupBy(*keys).agg(total_of(value, digits).alias(out))


def pivot_first(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    names: Sequence[str],
    order: str,
) -> DataFrame:
    """A column per name with the first non-null value in ``order``.

    One conditional aggregate: a name that never occurs becomes a NULL column, and
    there is one shuffle where the built-in pivot has two.
    """
    def first(wanted: str) -> Column:
        hit = (F.col(name) == wanted) & F.col(value).isNotNull()
        return F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col(order))).alias(wanted)

    return df.groupBy(*keys).agg(*[first(n) for n in names])


def pivot_revenue(
    rev: DataFrame, metrics: Sequence[str] = METRICS, order: str = "row_no"
) -> DataFrame:
    return pivot_first(rev, ENTITY_KEYS, "metric", "value_meur", metrics, order)


def join_revenue(headings: DataFrame, rev_wide: DataFrame) -> DataFrame:
    """Left join on (year, country); the strategy follows the measured size."""
    return headings.join(rev_wide, list(ENTITY_KEYS), "left")


def join_receipts(headings: DataFrame, receipts: DataFrame) -> DataFrame:
    return headings.join(receipts, list(ENTITY_KEYS), "left")


def country_coverage(
    df: DataFrame, entity: str = "country", period: str = "year", periods: int = 25
) -> DataFrame:
    """First, last and number of periods per entity, as a share of ``periods``."""
    present = F.countDistinct(period)
    return df.groupBy(entity).agg(
        F.min(period).alias("first_year"),
        F.max(period).alias("last_year"),
        present.alias("years_present"),
        percent_of(present, F.lit(periods)).alias("coverage_pct"),
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count("*").alias("n_entities"),
        F.count_if(F.col("coverage_pct") == 100.0).alias("n_full_coverage"),
    )


def heading_distribution(
    df: DataFrame,
    heading: str = "heading",
    value: str = "actual_meur",
    digits: int | None = None,
) -> DataFrame:
    return df.groupBy(heading).agg(
        F.count("*").alias("record_count"), mean_of_rows(value, digits).alias("avg_amount")
    )


def count_by(df: DataFrame, *keys: str, out: str = "record_count") -> DataFrame:
    """Rows per group: temporal distribution, rows by year, value counts."""
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def unique_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def min_records_check(df: DataFrame, period: str = "year", n: int = 50) -> DataFrame:
    """Periods with fewer than ``n`` records."""
    return count_by(df, period).where(F.col("record_count") < n)


def total_by_year_bn(
    df: DataFrame,
    period: str = "year",
    value: str = "actual_meur",
    out: str = "total_bn",
    digits: int | None = None,
) -> DataFrame:
    return df.groupBy(period).agg((total_of(value, digits) / F.lit(1000.0)).alias(out))


def mean_by(
    df: DataFrame, key: str, value: str, out: str, digits: int | None = None
) -> DataFrame:
    return df.groupBy(key).agg(mean_of_rows(value, digits).alias(out))


def sum_flag_by(df: DataFrame, flag: str, *keys: str, out: str = "anomaly_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(flag).cast("long")).alias(out))


def period_grid(
    df: DataFrame,
    entity: str,
    period: str,
    periods: Sequence[int],
    value: str | None = None,
    prefix: str = "y",
) -> DataFrame:
    """Entity by period grid of row counts, or of sums of ``value``, 0 where empty."""
    def cell(p: int) -> Column:
        here = F.col(period) == p
        if value is None:
            return F.count_if(here).alias(f"{prefix}{p}")
        amount = F.sum(F.when(here, F.col(value).cast("long")))
        return F.coalesce(amount, F.lit(0)).alias(f"{prefix}{p}")

    return df.groupBy(entity).agg(*[cell(p) for p in periods])

