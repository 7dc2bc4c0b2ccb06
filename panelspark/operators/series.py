"""Operators along the series of a panel: earlier values, trailing means, z-scores.

Lags count rows, not periods: a gap in a series makes a lag older than a period.

A window keeps a series in one task.  On a table with one row per period that is
bounded by the number of periods, which for calendar years is a few hundred.  For
fine periods pass ``chunk``: a series is then cut into ranges of ``chunk`` periods
that are handled in parallel, and each range receives the last rows before it.

These come from a segmented scan.  The last rows of each range go up a tree, ``FAN``
ranges a node; then every node hands down to its children what came before them.  Each
window of it holds at most ``FAN`` rows, so no task holds all ranges of a series.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.exprs import round_mul, safe_ratio
from panelspark.session import materialize


def attach(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of one row per key; NULL keys meet each other."""
    found = found.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(found, same, "left").drop(*[f"_of_{k}" for k in keys])


def earlier(col: str, i: int, by: Sequence[str], period: str) -> Column:
    return F.lag(col, i).over(Window.partitionBy(*by).orderBy(period))


def _with_earlier(
    df: DataFrame, value: str, by: Sequence[str], period: str, names: Sequence[str]
) -> DataFrame:
    cols = {name: earlier(value, i, by, period) for i, name in enumerate(names, 1)}
    return df.withColumns(cols)


#: Children of a node in the tree of ranges.
FAN = 64


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), F.lit(n))


def _carries(tails: DataFrame, by: Sequence[str], n: int, fan: int) -> DataFrame:
    """(by, _chunk, _carry): the last ``n`` rows before each range, oldest first.

    ``tails`` has (by, _chunk, _tail), the last ``n`` rows of each range that has any; it
    should be a stored table.
    """
    span = tails.agg(F.max("_chunk") - F.min("_chunk")).first()[0] or 0
    levels = [tails]
    while span >= fan:
        span = -(-span // fan)
        parts = F.sort_array(F.collect_list(F.struct("_chunk", "_tail")))
        joined = F.flatten(F.transform(parts, lambda p: p["_tail"]))
        up = levels[-1].groupBy(*by, F.floor(F.col("_chunk") / fan).cast("long").alias("_parent"))
        levels.append(materialize(up.agg(_last(joined, n).alias("_tail")).withColumnRenamed("_parent", "_chunk"), "tails"))

    def before(ranges) -> Column:
        """The tails of the ranges before, within the same parent."""
        none = F.slice("_tail", 1, 0)
        return F.concat(*[F.coalesce(F.lag("_tail", i).over(ranges), none) for i in range(n, 0, -1)])

    top = Window.partitionBy(*by).orderBy("_chunk")
    carries = levels[-1].select(*by, "_chunk", _last(before(top), n).alias("_carry"))
    for tails in reversed(levels[:-1]):
        placed = tails.withColumn("_parent", F.floor(F.col("_chunk") / fan).cast("long"))
        inside = Window.partitionBy(*by, "_parent").orderBy("_chunk")
        placed = placed.select(*by, "_parent", "_chunk", before(inside).alias("_near"))
        handed = carries.withColumnsRenamed({"_chunk": "_parent", "_carry": "_far"})
        met = attach(placed, handed, [*by, "_parent"])
        carries = met.select(*by, "_chunk", _last(F.concat("_far", "_near"), n).alias("_carry"))
    return carries


def _with_earlier_chunked(
    df: DataFrame, value: str, by: Sequence[str], period: str, names: Sequence[str], chunk: int, fan: int
) -> DataFrame:
    n = len(names)
    keys = [*by, "_chunk"]
    cut = df.withColumn("_chunk", F.floor(F.col(period) / F.lit(chunk)).cast("long"))

    # The last n rows of every range go up and down the tree of ranges.
    latest = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    tails = (
        cut.select(*keys, period, F.col(value).alias("_v"))
        .withColumn("_r", F.row_number().over(latest))
        .where(F.col("_r") <= n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(period, "_v"))).alias("_tail"))
    )
    carry = _carries(materialize(tails, "tails"), by, n, fan)

    inside = Window.partitionBy(*keys).orderBy(period)
    joined = attach(cut, carry, keys)
    cols = {}
    for i, name in enumerate(names, 1):
        # The row's place in its range tells how far back into the carry to reach.
        back = F.row_number().over(inside) - F.lit(i + 1)
        carried = F.try_element_at("_carry", F.least(back, F.lit(-1)).cast("int"))["_v"]
        local = F.row_number().over(inside) > i
        cols[name] = F.when(local, F.lag(value, i).over(inside)).otherwise(carried)
    return joined.withColumns(cols).drop("_chunk", "_carry")


def previous_values(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    period: str,
    names: Sequence[str],
    chunk: int | None = None,
) -> DataFrame:
    """Add the value 1, 2, ... rows earlier in the series, one column per name."""
    if chunk is None:
        return _with_earlier(df, value, by, period, names)
    return _with_earlier_chunked(df, value, by, period, names, chunk, FAN)


def lags(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    period: str,
    n: int = 3,
    prefix: str = "lag",
    chunk: int | None = None,
) -> DataFrame:
    return previous_values(df, value, by, period, [f"{prefix}{i}" for i in range(1, n + 1)], chunk)


def yoy_change(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    period: str,
    out: str = "yoy_change",
    digits: int = 2,
    chunk: int | None = None,
) -> DataFrame:
    """Change against the row before."""
    found = previous_values(df, value, by, period, ["_prev"], chunk)
    return found.withColumn(out, round_mul(F.col(value) - F.col("_prev"), digits)).drop("_prev")


def mean_of(names: Sequence[str], digits: int = 2, decimals: int | None = None) -> Column:
    """Mean of the non-null columns; with ``decimals`` they are added as decimals, exactly."""
    kind = "double" if decimals is None else f"decimal(34,{decimals})"
    values = [F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) for c in names]
    present = [F.col(c).isNotNull().cast("int") for c in names]
    total = reduce(lambda a, b: a + b, values).cast("double")
    return round_mul(safe_ratio(total, reduce(lambda a, b: a + b, present)), digits)


def rolling_mean_prev(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    period: str,
    n: int = 3,
    out: str = "roll_mean_3",
    digits: int = 2,
    chunk: int | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Mean of up to ``n`` earlier rows, the current one left out."""
    names = [f"_prev{i}" for i in range(1, n + 1)]
    found = previous_values(df, value, by, period, names, chunk)
    return found.withColumn(out, mean_of(names, digits, decimals)).drop(*names)


def zscore_over(value: Column | str, by: Sequence[str], digits: int = 3) -> Column:
    """z-score within groups of bounded size, as a window expression.

    Shares its shuffle with the other windows on the same keys.
    """
    group = Window.partitionBy(*by)
    value = F.col(value) if isinstance(value, str) else value
    gap = value - F.avg(value).over(group)
    return round_mul(safe_ratio(gap, F.stddev_samp(value).over(group)), digits)


def zscore(
    df: DataFrame, value: str, by: Sequence[str], out: str, digits: int = 3
) -> DataFrame:
    """z-score within groups of any size: group statistics joined back.

    The statistics combine partially, so a group with a third of the rows costs no
    single task; in the join it is split by the adaptive skew join if the
    statistics are too many to broadcast.  ``df`` is read twice.
    """
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")
    )
    joined = attach(df, stats, by)
    z = round_mul(safe_ratio(F.col(value) - F.col("_mean"), F.col("_std")), digits)
    return joined.withColumn(out, z).drop("_mean", "_std")
