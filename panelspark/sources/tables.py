"""Tables in the catalog: replaced as a whole, seen by every session, bucketed for windows."""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelspark.session import new_path


def _versions(spark: SparkSession, name: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary and t.name.startswith(f"{name}__v"))


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` under ``name`` in the catalog; readers see the old rows or the new ones.

    The rows become a table of their own first; then the name, a view of the catalog, is
    pointed at it in one step.  A failed write leaves the old rows in place.  The version
    before stays for readers that have begun, older ones go.
    """
    spark = df.sparkSession
    old = _versions(spark, name)
    version = f"{name}__v{len(old) and int(old[-1].split('__v')[1][:8]) + 1:08d}{uuid.uuid4().hex[:8]}"
    df.write.option("path", new_path(spark, version)).saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{version}`")
    for gone in old[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS `{gone}`")
    return spark.table(name)


def replace_table_as(df: DataFrame, name: str, sql: str) -> DataFrame:
    """``replace_table`` with the result of a query over ``{df}``, which may read the old rows."""
    return replace_table(df.sparkSession.sql(sql, df=df), name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP VIEW IF EXISTS `{name}`")
    for version in _versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS `{version}`")


def write_bucketed(
    df: DataFrame, name: str, by: Sequence[str], order: Sequence[str], buckets: int
) -> DataFrame:
    """A table of the catalog whose rows lie in buckets of ``by``, each sorted by ``by`` and ``order``.

    Windows, groupings and joins on ``by`` that read it need no exchange.  One task writes
    one bucket, so there is one file a bucket.
    """
    spark = df.sparkSession
    spread = df.repartition(buckets, *by)
    writer = spread.write.bucketBy(buckets, *by).sortBy(*by, *order).option("path", new_path(spark, name))
    writer.mode("overwrite").saveAsTable(name)
    return spark.table(name)
