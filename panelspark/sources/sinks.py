"""Writers: Parquet and CSV tables, one-row JSON documents, and SQL views."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from panelspark.session import materialize


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write every partition in parallel; CSV files get a header line."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        writer.format(fmt).save(path)


def write_sorted(
    df: DataFrame, path: str, by: list[str], fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Range-partition, then sort within partitions: a total order, never one task."""
    write_table(df.orderBy(*by), path, fmt, mode)


def write_document(one_row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a one-row table as a single JSON document."""
    one_row.coalesce(1).write.mode(mode).json(path)


def cache_table(df: DataFrame) -> DataFrame:
    """Keep a table in memory, spilling to disk; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """A cached table for several reads; its blocks are released at the end."""
    kept = cache_table(df)
    try:
        yield kept
    finally:
        kept.unpersist()


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a table to SQL."""
    df.createOrReplaceTempView(name)
    return df


def create_or_replace_table_as(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Store the result of a query over ``{df}`` and give it a name for later SQL.

    The rows are written once to the shared folder: reads of the name see that
    snapshot, whatever becomes of the inputs.
    """
    return register_view(materialize(df.sparkSession.sql(sql, df=df), name), name)
