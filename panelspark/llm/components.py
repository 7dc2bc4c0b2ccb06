"""Connected components as rounds of joins; no list of links leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest of the neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def component_roots(edges: DataFrame) -> DataFrame:
    """(u, root) for every node with a link to a smaller one; ``edges`` has longs u, v.

    Alternates the large-star and small-star steps until nothing changes, which takes
    a number of rounds that grows with the logarithm of the largest component.  Every
    round is written to the shared folder, so a lost executor repeats no earlier round.
    Self links and repeated links are fine; no edges give no rows.
    """
    edges = edges.filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = materialize(edges.distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root"))
