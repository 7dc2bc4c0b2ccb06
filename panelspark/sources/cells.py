"""Reading a grid of sheets in long form."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.schemas import CELL


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load cells (sheet, row_no, col_no, s, n); CSV files carry a header line."""
    reader = spark.read.schema(CELL).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def select_year_sheets(cells: DataFrame) -> DataFrame:
    """Keep the sheets whose name is an integer, and add it as ``year``."""
    year = F.expr("try_cast(sheet AS INT)")
    return cells.withColumn("year", year).where(F.col("year").isNotNull())
