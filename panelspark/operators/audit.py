"""Data-quality profiles.  Each is one aggregate over the table, or a few for quantiles."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from panelspark.functions.exprs import mean_of_rows, percent_of, round_mul
from panelspark.operators.quantiles import exact_quantiles
from panelspark.session import materialize

Rule = tuple[str, Column]

_QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _long(one_row: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """One-row table to (label, value) rows; other columns are repeated."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in names]
    )
    kept = [c for c in one_row.columns if c not in names]
    return one_row.select(*kept, F.inline(pairs))


def with_one_row(df: DataFrame, *one_rows: DataFrame) -> DataFrame:
    """Add the columns of one-row tables, read as scalar subqueries: no join."""
    for i, one in enumerate(one_rows):
        df = df.withColumn(f"_one{i}", one.select(F.struct(*one.columns)).scalar())
    added = [f"_one{i}" for i in range(len(one_rows))]
    kept = [c for c in df.columns if c not in added]
    return df.select(*kept, *[f"{c}.*" for c in added])


def null_profile(df: DataFrame, warn_pct: float = 20.0) -> DataFrame:
    """(column_name, null_count, null_pct, status) per column."""
    names = df.columns
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]
    return _null_rows(df.agg(F.count("*").alias("_n"), *counts), names, warn_pct)


def _null_rows(counts: DataFrame, names: Sequence[str], warn_pct: float) -> DataFrame:
    """The rows of ``null_profile`` from one row of counts and the number ``_n`` of rows."""
    long = _long(counts, names, "column_name", "null_count")
    pct = percent_of("null_count", "_n")
    return long.select(
        "column_name",
        "null_count",
        round_mul(pct, 2).alias("null_pct"),
        F.when(pct < warn_pct, "OK").otherwise("WARNING").alias("status"),
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Total, distinct and duplicate rows.  Copies collapse before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    counts = groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total"), F.count("*").alias("distinct")
    )
    extra = F.col("total") - F.col("distinct")
    share = F.coalesce(percent_of(extra, "total"), F.lit(0.0))
    return counts.select(
        "total",
        "distinct",
        extra.alias("duplicate_count"),
        round_mul(share, 2).alias("duplicate_pct"),
        F.when(extra == 0, "OK").otherwise("Review").alias("status"),
    )


def quartiles(df: DataFrame, col: str, accuracy: int | None = None) -> DataFrame:
    """One row (q25, median, q75): exact, or from a mergeable sketch of ``accuracy``."""
    if accuracy is not None:
        return df.agg(
            *[F.percentile_approx(col, q, accuracy).alias(n) for n, q in _QUARTILES.items()]
        )
    found = exact_quantiles(df, col, list(_QUARTILES.values()))
    return found.agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in _QUARTILES.items()]
    )


def amount_stats(
    df: DataFrame, col: str, accuracy: int | None = None, digits: int | None = None
) -> DataFrame:
    """One row: mean, sample stddev, min, max, q25, median, q75."""
    moments = df.agg(
        mean_of_rows(col, digits).alias("mean"),
        F.stddev_samp(col).alias("stddev"),
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
    )
    return with_one_row(moments, quartiles(df, col, accuracy))


@dataclass(frozen=True)
class Scan:
    """What one scan of a table leaves behind.

    ``metrics`` is one row: rows, a count of nulls per column (nulls0, nulls1, ...), mean,
    stddev, min, max, negative and max_period.  ``narrow`` is a stored table with the
    amount (``amount``) and two 64-bit hashes of the whole row (``h1``, ``h2``); ``stored``
    is the whole table where it was to be written anyway.
    """

    columns: list[str]
    metrics: DataFrame
    narrow: DataFrame
    stored: DataFrame | None = None

    def null_profile(self, warn_pct: float = 20.0) -> DataFrame:
        named = [F.col(f"nulls{i}").alias(c) for i, c in enumerate(self.columns)]
        return _null_rows(self.metrics.select(F.col("rows").alias("_n"), *named), self.columns, warn_pct)

    def duplicate_profile(self) -> DataFrame:
        """As of whole rows, told apart by 128 bits of hash."""
        return duplicate_profile(self.narrow.select("h1", "h2"))

    def amount_stats(self, accuracy: int | None = None) -> DataFrame:
        moments = self.metrics.select("mean", "stddev", "min", "max")
        return with_one_row(moments, quartiles(self.narrow, "amount", accuracy))

    def iqr_outliers(self, k: float = 3.0, accuracy: int | None = None) -> DataFrame:
        return _outside(self.narrow, "amount", fences(self.amount_stats(accuracy), k))

    def negative_count(self) -> DataFrame:
        return self.metrics.select("negative")

    def max_period(self) -> DataFrame:
        return self.metrics.select("max_period")


def profile_scan(
    df: DataFrame, amount: str, period: str = "year", digits: int | None = None, whole: bool = False
) -> Scan:
    """Reads ``df`` once: all counts and moments are observed while its narrow form is written.

    With ``whole`` the table itself is what is written, and the narrow form is read from it
    with its columns pruned.  The observed node stands directly below the write, so a
    retried task is counted once.
    """
    spark, names = df.sparkSession, df.columns
    v = F.col(f"`{amount}`").cast("double")
    seen = Observation()
    gathered = df.observe(
        seen,
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls{i}") for i, c in enumerate(names)],
        mean_of_rows(v, digits).alias("mean"),
        F.stddev_samp(v).alias("stddev"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v < 0).alias("negative"),
        F.max(F.col(f"`{period}`").cast("long")).alias("max_period"),
    )
    cols = [F.col(f"`{c}`") for c in names]
    # hashes pass over nulls, so where they are counts as a value
    missing = F.concat_ws("", *[c.isNull().cast("int").cast("string") for c in cols])
    narrow = [v.alias("amount"), F.xxhash64(missing, *cols).alias("h1"), F.xxhash64(*cols[::-1], missing).alias("h2")]
    if whole:
        stored = materialize(gathered, "profiled")
        found = stored.select(*narrow)
    else:
        stored, found = None, materialize(gathered.select(*narrow), "profile")
    got = seen.get
    kinds = {"mean": "double", "stddev": "double", "min": "double", "max": "double"}
    order = ["rows", *[f"nulls{i}" for i in range(len(names))], "mean", "stddev", "min", "max", "negative", "max_period"]
    ddl = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in order)
    metrics = spark.createDataFrame([tuple(got[c] for c in order)], ddl)
    return Scan(names, metrics, found, stored)


def range_outliers(df: DataFrame, col: str, low: Column, high: Column) -> DataFrame:
    return df.where((F.col(col) < low) | (F.col(col) > high))


def fences(stats: DataFrame, k: float = 3.0) -> DataFrame:
    """Add iqr, lower_bound and upper_bound to the one row of ``amount_stats``."""
    iqr = F.col("q75") - F.col("q25")
    return stats.withColumns(
        {
            "iqr": iqr,
            "lower_bound": F.col("q25") - F.lit(k) * iqr,
            "upper_bound": F.col("q75") + F.lit(k) * iqr,
        }
    )


def iqr_outliers(
    df: DataFrame,
    col: str,
    k: float = 3.0,
    accuracy: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """One row: the stats, the fences, and the rows outside them.

    The fences reach the scan as one scalar subquery: a filter, no join.
    """
    return _outside(df, col, fences(amount_stats(df, col, accuracy, digits), k))


def _outside(df: DataFrame, col: str, bounds: DataFrame) -> DataFrame:
    """The one row of bounds with the number and share of rows outside them."""
    fence = bounds.select(F.struct(*bounds.columns)).scalar()
    outside = (F.col(col) < fence["lower_bound"]) | (F.col(col) > fence["upper_bound"])
    counts = df.agg(F.count_if(outside).alias("outlier_count"), F.count("*").alias("_n"))
    return counts.select(
        *[fence[c].alias(c) for c in bounds.columns],
        "outlier_count",
        percent_of("outlier_count", "_n").alias("outlier_pct"),
    )


def negative_rows(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) < 0)


def standard_rules(
    entities: Sequence[str], first_year: int = 2000, last_year: int = 2024
) -> list[Rule]:
    """Documented constraints of the feature table."""
    return [
        ("year_in_range", F.col("year").between(first_year, last_year)),
        ("country_in_list", F.col("country").isin(*entities)),
        ("heading_not_null", F.col("heading").isNotNull()),
        ("actual_not_negative", F.col("actual_meur") >= 0),
        ("earmarked_not_negative", F.col("earmarked_meur") >= 0),
        ("rate_in_range", F.col("absorption_rate_pct").between(0.0, 120.0)),
        ("rate_over_100", F.col("absorption_rate_pct") <= 100.0),
        ("net_pct_in_range", F.col("net_pct_gni").between(-10.0, 5.0)),
    ]


def constraint_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, violations) of all rules in one pass; an unknown value violates nothing."""
    counts = [F.count_if(~rule).alias(name) for name, rule in rules]
    return _long(df.agg(*counts), [name for name, _ in rules], "rule", "violations")


def quality_score(
    null_p: DataFrame,
    dup_p: DataFrame,
    out_p: DataFrame,
    max_year: DataFrame,
    fresh_year: int = 2023,
    good: float = 85.0,
    excellent: float = 95.0,
) -> DataFrame:
    """Four part scores, their mean and a status, from the one-row profiles.

    ``max_year`` is a one-row table with the latest period.
    """
    nulls = null_p.agg((F.lit(100.0) - F.avg("null_pct")).alias("completeness"))
    accuracy = out_p.select((F.lit(100.0) - F.col("outlier_pct") / 2.0).alias("accuracy"))
    share = percent_of("duplicate_count", "total")
    consistency = dup_p.select(
        (F.lit(100.0) - F.coalesce(share, F.lit(0.0))).alias("consistency")
    )
    fresh = F.when(F.col(max_year.columns[0]) >= fresh_year, 100.0).otherwise(90.0)
    timeliness = max_year.select(fresh.alias("timeliness"))
    parts = with_one_row(nulls, accuracy, consistency, timeliness)
    names = ["completeness", "accuracy", "consistency", "timeliness"]
    overall = (F.col(names[0]) + F.col(names[1]) + F.col(names[2]) + F.col(names[3])) / 4.0
    status = (
        F.when(overall >= excellent, "EXCELLENT")
        .when(overall >= good, "GOOD")
        .otherwise("NEEDS IMPROVEMENT")
    )
    return parts.select(
        *[round_mul(n, 1).alias(n) for n in names],
        round_mul(overall, 1).alias("overall"),
        status.alias("status"),
    )
