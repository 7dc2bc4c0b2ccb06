"""Labels from a table of intervals, without comparing every row with every interval."""

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.series import attach
from panelspark.session import materialize

#: Share of the mean length of the intervals that a bin has.
_BINS = 1.0


def _bin(c: Column, low: float, width: float) -> Column:
    return F.floor((c - F.lit(low)) / F.lit(width)).cast("long")


def interval_label(
    df: DataFrame,
    value: str,
    intervals: DataFrame,
    out: str,
    closed: str = "both",
) -> DataFrame:
    """Add the label of the interval that holds ``value``; NULL outside of all.

    ``intervals`` has (start, end, label, ordinal); a NULL bound is open without end.  With
    ``closed='left'`` the end belongs to the next interval.  Where intervals overlap the
    smallest ordinal wins, then the smallest label.

    The axis is cut into bins as wide as the intervals are on average, so an interval
    spreads over few of them and a value lies in one: the join is an equality on the bin,
    followed by an exact check.  Only distinct values are joined, so a value that a third
    of the rows have is looked up once.
    """
    if closed not in ("both", "left"):
        raise ValueError("closed must be both or left")
    v = F.col(value).cast("double")
    distinct = materialize(df.select(v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").distinct(), "values")
    low, high = distinct.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast(intervals.schema["label"].dataType))
    start, end = F.col("start").cast("double"), F.col("end").cast("double")
    # what lies outside the values needs no bins
    used = intervals.select(
        F.greatest(F.coalesce(start, F.lit(low)), F.lit(low)).alias("_a"),
        F.least(F.coalesce(end, F.lit(high)), F.lit(high)).alias("_b"),
        start.alias("_start"),
        end.alias("_end"),
        "label",
        "ordinal",
    ).where("_a <= _b")
    used = materialize(used, "intervals")
    length = used.agg(F.avg(F.col("_b") - F.col("_a"))).first()[0] or 0.0
    width = max(length * _BINS, (high - low) * 1e-9, 1e-300)
    spread = used.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_a"), low, width), _bin(F.col("_b"), low, width))))
    inside = F.coalesce(F.col("_v") >= F.col("_start"), F.lit(True))
    before_end = F.col("_v") <= F.col("_end") if closed == "both" else F.col("_v") < F.col("_end")
    met = distinct.withColumn("_bin", _bin(F.col("_v"), low, width)).join(spread, "_bin")
    met = met.where(inside & F.coalesce(before_end, F.lit(True)))
    first = met.groupBy("_v").agg(F.min(F.struct("ordinal", "label")).alias("_first"))
    named = first.select("_v", F.col("_first.label").alias(out))
    return attach(df.withColumn("_v", v), named, ["_v"]).drop("_v")
