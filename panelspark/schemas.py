"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, dtype, null) for name, dtype, null in fields])


_INT, _LONG, _STR, _DBL = IntegerType(), LongType(), StringType(), DoubleType()

# Long form of a grid of sheets; at most one of s (text) and n (number) is set.
CELL = _schema(
    ("sheet", _STR, False),
    ("row_no", _INT, False),
    ("col_no", _INT, False),
    ("s", _STR, True),
    ("n", _DBL, True),
)

EXPENDITURE = _schema(
    ("year", _INT, False),
    ("country", _STR, False),
    ("heading_raw", _STR, True),
    ("heading", _STR, True),
    ("actual_meur", _DBL, True),
    ("earmarked_meur", _DBL, True),
    ("is_ngeu", _INT, False),
    ("is_preliminary", _INT, False),
    ("row_no", _LONG, False),
)

REVENUE = _schema(
    ("year", _INT, False),
    ("country", _STR, False),
    ("metric", _STR, False),
    ("value_meur", _DBL, True),
    ("row_no", _LONG, False),
)

FEATURES = _schema(
    ("year", _INT, True),
    ("country", _STR, True),
    ("heading", _STR, True),
    ("actual_meur", _DBL, True),
    ("earmarked_meur", _DBL, True),
    ("is_ngeu", _INT, True),
    ("is_preliminary", _INT, True),
    ("receipts_meur", _DBL, True),
    ("total_contributions", _DBL, True),
    ("gni_size", _DBL, True),
    ("net_pct_gni", _DBL, True),
    ("net_position_meur", _DBL, True),
    ("absorption_gap_meur", _DBL, True),
    ("absorption_rate_pct", _DBL, True),
    ("yoy_change", _DBL, True),
    ("lag1", _DBL, True),
    ("lag2", _DBL, True),
    ("lag3", _DBL, True),
    ("roll_mean_3", _DBL, True),
    ("year_index", _INT, True),
    ("zscore_absorption", _DBL, True),
    ("zscore_net", _DBL, True),
)

NET_POSITION = _schema(
    ("country", _STR, True),
    ("year", _INT, True),
    ("net_position_meur", _DBL, True),
    ("net_pct_gni", _DBL, True),
    ("zscore_net", _DBL, True),
    ("receipts_meur", _DBL, True),
    ("total_contributions", _DBL, True),
    ("h1_anomaly", _INT, True),
    ("net_position_lag1", _DBL, True),
    ("net_position_change", _DBL, True),
)

SCORED = _schema(
    ("year", _INT, True),
    ("country", _STR, True),
    ("heading", _STR, True),
    ("absorption_gap_meur", _DBL, True),
    ("absorption_rate_pct", _DBL, True),
    ("lag1", _DBL, True),
    ("lag2", _DBL, True),
    ("lag3", _DBL, True),
    ("roll_mean_3", _DBL, True),
    ("zscore_absorption", _DBL, True),
    ("if_anomaly", _INT, True),
    ("if_score", _DBL, True),
    ("lof_anomaly", _INT, True),
    ("lof_score", _DBL, True),
)


def enforce_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to ``schema``, in its column order.

    A NULL in a column declared not-null fails the job when the row is read, so
    bad rows are never dropped silently.  NaN becomes NULL in double columns.
    """
    cols = []
    for field in schema.fields:
        col = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, DoubleType):
            col = F.when(~F.isnan(col), col)
        if not field.nullable:
            message = F.lit(f"column {field.name} must not be null")
            col = F.coalesce(col, F.raise_error(message).cast(field.dataType))
        cols.append(col.alias(field.name))
    return df.select(*cols)
