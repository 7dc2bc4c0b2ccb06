"""Ordered substring crosswalks: the first rule, in order, whose key occurs wins."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.exprs import column

# Budget headings, the key is looked for in the lower-case label.
HEADING_RULES = [
    ("1. agriculture", "Agriculture & Rural Dev"),
    ("preservation and management", "Agriculture & Rural Dev"),
    ("natural resources", "Agriculture & Rural Dev"),
    ("2. structural actions", "Structural & Cohesion"),
    ("sustainable growth", "Structural & Cohesion"),
    ("smart and inclusive growth", "Structural & Cohesion"),
    ("cohesion, resilience", "Structural & Cohesion"),
    ("3. internal policies", "Internal / Single Market"),
    ("single market, innovation", "Internal / Single Market"),
    ("4. external actions", "External & Global"),
    ("eu as a global player", "External & Global"),
    ("global europe", "External & Global"),
    ("neighbourhood and the world", "External & Global"),
    ("administration", "Administration"),
    ("citizenship, freedom", "Security & Citizenship"),
    ("security and citizenship", "Security & Citizenship"),
    ("migration and border", "Security & Citizenship"),
    ("security and defence", "Security & Citizenship"),
    ("7. pre-accession", "Pre-Accession"),
    ("nextgenerationeu", "NGEU Recovery"),
]

# Revenue metrics, compared without regard to case.
METRIC_RULES = [
    ("TOTAL national contribution", "total_contributions"),
    ("TOTAL National contributions", "total_contributions"),
    ("GNP-based own resource", "gni_contribution"),
    ("GNI-based own resource", "gni_contribution"),
    ("Own resources based on GNI", "gni_contribution"),
    ("VAT-based own resource", "vat_contribution"),
    ("Own resources based on VAT", "vat_contribution"),
    ("Traditional own resources", "customs"),
    ("Customs duties", "customs"),
    ("Gross National Income", "gni_size"),
    ("TOTAL EXPENDITURE", "total_expenditure"),
]

# The columns of the wide revenue table.
METRICS = [
    "total_contributions",
    "gni_size",
    "gni_contribution",
    "vat_contribution",
    "customs",
    "total_expenditure",
]

Rules = Sequence[tuple[str, str]]


def ordered_map(label: Column | str, rules: Rules) -> Column:
    """Value of the first matching rule, NULL without a match."""
    low = F.lower(column(label))
    chain = None
    for key, value in rules:
        hit = low.contains(key.lower())
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def map_heading(label: Column | str, rules: Rules = HEADING_RULES) -> Column:
    return ordered_map(label, rules)


def map_metric(label: Column | str, rules: Rules = METRIC_RULES) -> Column:
    return ordered_map(label, rules)


def crosswalk_join(df: DataFrame, label: str, rules: DataFrame, out: str = "heading") -> DataFrame:
    """The same mapping with any number of rules in a table (ordinal, key, value).

    Each distinct label is cut into its pieces of the lengths that keys have, pieces meet
    keys by equality, and the first rule found is joined back by label.  A NULL label and a
    NULL key meet nothing; an empty key meets every label.
    """
    keys = rules.select("ordinal", F.lower("key").alias("_key"), F.col("value").alias(out))
    first = keys.groupBy("_key").agg(F.min_by(out, "ordinal").alias(out), F.min("ordinal").alias("_ord"))
    sizes = keys.agg(F.collect_set(F.length("_key"))).scalar()
    names = df.select(F.col(label).alias("_label")).where("_label IS NOT NULL").distinct()
    names = names.withColumns({"_low": F.lower("_label"), "_sizes": sizes})

    def of_size(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length("_low") - size + 1)
        return F.transform(starts, lambda at: F.substring(F.col("_low"), at, size))

    fitting = F.filter("_sizes", lambda size: size <= F.length("_low"))
    pieces = F.array_distinct(F.flatten(F.transform(fitting, of_size)))
    cut = names.select("_label", F.explode(pieces).alias("_key"))
    hits = cut.join(first, "_key").groupBy("_label").agg(F.min_by(out, "_ord").alias(out))
    return df.join(hits, F.col(label) == F.col("_label"), "left").drop("_label")
