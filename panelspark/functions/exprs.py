"""Guarded arithmetic that stays inside whole-stage codegen."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

_LOW_BITS = 20
# Up to here a double times a power of ten finds its whole number again.
_EXACT_UNITS = 2e15


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_mul(c: Column | str, digits: int) -> Column:
    """Round half away from zero on the scaled binary value, x*10^n then /10^n."""
    c = column(c).cast("double")
    if digits == 0:
        return F.round(c, 0)
    factor = float(10**digits)
    return F.round(c * F.lit(factor), 0) / F.lit(factor)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator; NULL where the denominator is 0 or NULL."""
    below = column(denominator).cast("double")
    return column(numerator).cast("double") / F.nullif(below, F.lit(0.0))


def percent_of(part: Column | str, total: Column | str) -> Column:
    return safe_ratio(column(part).cast("double") * F.lit(100.0), total)


def _units(v: Column, digits: int) -> Column:
    half = F.when(v < 0, -0.5).otherwise(0.5)
    return (v * F.lit(float(10**digits)) + half).cast("bigint")


def round_amount(c: Column | str, digits: int) -> Column:
    """The amount rounded half away from zero to ``digits``, for values below 9.2e18 units."""
    return _units(column(c).cast("double"), digits).cast("double") / F.lit(float(10**digits))


def exact_sum_decimal(c: Column | str, digits: int) -> Column:
    """Sum of values with at most ``digits`` (0 to 6) decimals: exact in any task order.

    Nothing is rounded: a value with further decimals fails the job.  Values whose units
    a double holds exactly are added as two integers, the high and the low bits, which keeps
    the aggregation on primitive buffers; larger ones are added as decimals of 38 digits.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must lie between 0 and 6")
    v = column(c).cast("double")
    kind = f"decimal(38,{digits})"
    off_grid = F.raise_error(F.concat(F.lit(f"more than {digits} decimals: "), v.cast("string")))
    small = F.abs(v) < F.lit(_EXACT_UNITS / 10**digits)
    whole = F.when(small, _units(v, digits))
    same = whole.cast("double") / F.lit(float(10**digits)) == v
    units = F.when(small, F.when(same, whole).otherwise(off_grid.cast("bigint")))
    wide = F.when(~small, v.cast(kind))
    rest = F.sum(F.when(~small, F.when(wide.cast("double") == v, wide).otherwise(off_grid.cast(kind))))
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(19,0)")
    total = (high * F.lit(Decimal(1 << _LOW_BITS)) + low) * F.lit(Decimal(1).scaleb(-digits))
    both = F.when(rest.isNull(), total).when(total.isNull(), rest).otherwise(total + rest)
    return both.cast(kind)


def exact_sum(c: Column | str, digits: int) -> Column:
    return exact_sum_decimal(c, digits).cast("double")


def total_of(c: Column | str, digits: int | None = None) -> Column:
    """Sum as a double: plain, or exact where the caller declares the decimals."""
    return F.sum(column(c).cast("double")) if digits is None else exact_sum(c, digits)


def mean_of_rows(c: Column | str, digits: int | None = None) -> Column:
    """Mean as a double: plain, or from the exact sum where the decimals are declared."""
    c = column(c)
    if digits is None:
        return F.avg(c.cast("double"))
    return exact_sum(c, digits) / F.nullif(F.count(c).cast("double"), F.lit(0.0))


def net_position(receipts: Column | str, contributions: Column | str) -> Column:
    """Receipts minus contributions: positive for a net receiver."""
    return round_mul(column(receipts) - column(contributions), 2)


def net_pct_gni(
    receipts: Column | str, contributions: Column | str, gni: Column | str
) -> Column:
    net = column(receipts) - column(contributions)
    return round_mul(safe_ratio(net, gni) * F.lit(100.0), 4)


def absorption_gap(earmarked: Column | str, actual: Column | str) -> Column:
    return round_mul(column(earmarked) - column(actual), 2)


def absorption_rate(actual: Column | str, earmarked: Column | str) -> Column:
    return round_mul(percent_of(actual, earmarked), 2)


def year_index(year: Column | str, base_year: int = 2000) -> Column:
    return (column(year) - F.lit(base_year)).cast("int")


def scale_to_bn(c: Column | str) -> Column:
    return column(c).cast("double") / F.lit(1000.0)


def format_now(pattern: str = "yyyy-MM-dd HH:mm:ss", at: Column | str | None = None) -> Column:
    """The clock as text, or the given time."""
    return F.date_format(F.current_timestamp() if at is None else column(at), pattern)


def to_json_document(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))
