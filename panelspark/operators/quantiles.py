"""Exact quantiles of a column of any size, by one method.

A global ``percentile`` merges every distinct value in one task.  Here the value axis is
narrowed instead: each pass counts rows per slot of an order-preserving slot number,
partial sums first, and keeps the slot that holds the wanted rank.
After the logarithmic slots and one linear refinement a slot spans at most 2^22
neighbouring doubles, which the last pass counts one by one.  Every pass moves at
most (number of quantiles) x (number of slots) counts into a task, whatever the
number of rows and however many of them share a value.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_PER_OCTAVE = 1024
_SLOTS = 1 << 20
_LOWEST_EXPONENT = 1075.0
_END_SLOT = 1 << 22


def _log_slot(v: Column) -> Column:
    """Monotone slot number: 1024 slots per power of two, mirrored for negatives.

    The infinities have a slot each at the ends.
    """
    size = F.floor((F.log2(F.abs(v)) + F.lit(_LOWEST_EXPONENT)) * F.lit(float(_PER_OCTAVE))) + 1
    size = F.when(F.abs(v) == F.lit(float("inf")), _END_SLOT).otherwise(size)
    slot = F.when(v > 0, size).when(v < 0, -size).otherwise(0)
    return slot.cast("long")


def _linear_slot(v: Column, low: Column, high: Column) -> Column:
    """Monotone slot number between the smallest and largest value of a slot."""
    share = F.when(high > low, (v - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)
    return F.floor(share * F.lit(float(_SLOTS))).cast("long")


def _ranks(qs: Sequence[float], interpolate: bool) -> Column:
    """Per quantile the two wanted ranks (1-based) and the weight of the upper one."""
    n = F.col("n").cast("double")
    entries = []
    for i, q in enumerate(qs):
        q = F.lit(float(q))
        if interpolate:
            at = (n - 1.0) * q
            low, high, share = F.floor(at) + 1, F.ceil(at) + 1, at - F.floor(at)
        else:
            low = F.greatest(n - F.floor(n - n * q), F.lit(1.0))
            high, share = low, F.lit(0.0)
        entries.append(
            F.struct(
                F.lit(i).alias("qi"),
                q.alias("q"),
                F.array_distinct(F.array(low.cast("long"), high.cast("long"))).alias("ranks"),
                share.cast("double").alias("share"),
            )
        )
    return F.explode(F.array(*entries))


def _reached(counts: DataFrame) -> DataFrame:
    """Keep the slot whose cumulative count reaches the rank; rank within it."""
    before = F.col("upto") - F.col("c")
    kept = counts.where((F.col("upto") >= F.col("rank")) & (before < F.col("rank")))
    return kept.withColumn("rank", F.col("rank") - before)


def _first_pass(values: DataFrame, qs: Sequence[float], interpolate: bool) -> DataFrame:
    """Count all rows per logarithmic slot and pick the slots of the wanted ranks.

    There are at most 2 * 1024 * 2100 slots, so their running count fits one task.
    """
    counts = values.groupBy("s0").agg(
        F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    running = Window.orderBy("s0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns(
        {"upto": F.sum("c").over(running), "n": F.sum("c").over(Window.partitionBy())}
    )
    ranked = counts.select("*", _ranks(qs, interpolate).alias("w")).select("*", "w.*")
    ranked = ranked.withColumn("id", F.explode("ranks")).withColumn("rank", F.col("id"))
    return _reached(ranked).select("qi", "q", "share", "id", "rank", "s0", "low", "high")


def _next_pass(values: DataFrame, wanted: DataFrame, slot: Column) -> DataFrame:
    """Split the wanted slots further; ``wanted`` has two rows per quantile at most."""
    bounds = wanted.withColumnRenamed("s0", "w0")
    within = (F.col("s0") == F.col("w0")) & F.col("v").between(F.col("low"), F.col("high"))
    inside = values.join(F.broadcast(bounds), within).withColumn("slot", slot)
    counts = inside.groupBy("qi", "q", "share", "id", "rank", "s0", "slot").agg(
        F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    running = (
        Window.partitionBy("qi", "id")
        .orderBy("slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = counts.withColumn("upto", F.sum("c").over(running))
    return _reached(counts).drop("slot", "c", "upto")


def exact_quantiles(
    df: DataFrame,
    col: str,
    qs: Sequence[float],
    interpolate: bool = False,
) -> DataFrame:
    """One row (q, value) per quantile, NULL and NaN left out.

    Without interpolation the value is an element of the column; with it, a step
    from one infinity to the other is NaN.  ``df`` is scanned three times for one
    column, so it should be a stored table.
    """
    v = F.col(col).cast("double")
    values = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = values.withColumn("s0", _log_slot(F.col("v")))

    wanted = _first_pass(values, qs, interpolate)
    linear = _linear_slot(F.col("v"), F.col("low"), F.col("high"))
    wanted = _next_pass(values, wanted, linear)
    exact = _next_pass(values, wanted, F.col("v"))

    lower, upper = F.min("low"), F.max("low")
    between = lower * (1.0 - F.col("share")) + upper * F.col("share")
    value = F.when(lower == upper, lower).otherwise(between)
    return exact.groupBy("q", "share").agg(value.alias("value")).select("q", "value")
