"""Parting rows by the rules they break, and counting the breaches in the same pass."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from panelspark.operators.audit import Rule


def broken_rules(rules: Sequence[Rule]) -> Column:
    """A bit mask of the rules a row breaks; an unknown value breaks nothing."""
    if not 0 < len(rules) <= 62:
        raise ValueError("between 1 and 62 rules fit the mask")
    bits = [F.when(~rule, F.lit(1 << i)).otherwise(0).cast("long") for i, (_, rule) in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def named_rules(mask: Column, rules: Sequence[Rule]) -> Column:
    """The names of the rules of a mask, in their order."""
    names = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, (name, _) in enumerate(rules)]
    return F.array_compact(F.array(*names))


def part_rows(df: DataFrame, rules: Sequence[Rule], path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean rows, quarantined rows with ``broken``, counts (rule, violations)).

    ``df`` is read once: every row gets its mask, one write parts the rows by it below
    ``path``, and the counts are observed on the way.
    """
    spark = df.sparkSession
    seen = Observation()
    masked = df.withColumn("_mask", broken_rules(rules))
    counts = [F.count_if(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"n{i}") for i in range(len(rules))]
    parted = masked.withColumns({"broken": named_rules(F.col("_mask"), rules), "_clean": F.col("_mask") == 0})
    parted.observe(seen, *counts).drop("_mask").write.partitionBy("_clean").parquet(path)
    got = seen.get
    found = spark.createDataFrame([(name, got[f"n{i}"]) for i, (name, _) in enumerate(rules)], "rule string, violations long")
    schema = parted.drop("_mask").schema
    stored = spark.read.schema(schema).parquet(path)
    clean = stored.where("_clean").select(*df.columns)
    return clean, stored.where("NOT _clean").select(*df.columns, "broken"), found
