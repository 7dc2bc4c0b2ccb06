"""Isolation Forest (Liu, Ting, Zhou 2008) grown level by level from hashed draws.

Nothing is drawn from a generator.  A tree's rows are those with the smallest values of a
hash of the row key that is the tree's own, out of all rows; a node's feature and cut come
from the md5 digits of (seed, tree, node).  So scores depend neither on the partitioning of
the input nor on a recomputed task, and another engine grows the same trees.
"""

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from panelspark.operators.matrix import filled
from panelspark.operators.thresholds import flag_below
from panelspark.session import materialize

#: Row hashes are numbers below this prime; a tree's hash is linear in them.
_PRIME = (1 << 31) - 1
#: Path lengths are added as whole units, so the order of the trees does not matter.
_UNITS = 1e9


def mean_path(size):
    """Average path length of an unsuccessful search among ``size`` rows."""
    size = np.asarray(size, dtype="float64")
    safe = np.maximum(size, 3.0)
    harmonic = np.log(safe - 1.0) + np.euler_gamma
    long = 2.0 * harmonic - 2.0 * (safe - 1.0) / safe
    return np.where(size <= 1.0, 0.0, np.where(size == 2.0, 1.0, long))


def _hex(digits: Column, start: int, n: int) -> Column:
    """``n`` of the digits, from 1, as a number."""
    return F.conv(F.substring(digits, start, n), 16, 10).cast("bigint")


def _tree_hashes(trees: int, seed: int) -> tuple[list[int], list[int]]:
    """Factor and summand of each tree's hash."""
    found = [hashlib.md5(f"{seed}:{t}".encode()).hexdigest() for t in range(trees)]
    return [1 + int(h[:8], 16) % (_PRIME - 1) for h in found], [int(h[8:16], 16) % _PRIME for h in found]


def sample_rows(
    df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """(tree, x, n): for each tree the ``sample`` rows with its smallest hashes, of all rows.

    Only rows below a bound on the hash are ranked.  The bound lets a few more rows than
    needed through on average; where a tree gets too few the bound is doubled and the rows
    are read again, so the rows found are always the smallest of all.  Ties go by ``key``.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    u = _hex(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8) % _PRIME
    factors, summands = ([F.lit(v).cast("bigint") for v in vs] for vs in _tree_hashes(trees, seed))
    hashed = df.select(F.array(*filled(cols)).alias("x"), *key, u.alias("_u"))

    def hit(t: Column) -> Column:
        h = (F.get(F.array(*factors), t) * F.col("_u") + F.get(F.array(*summands), t)) % _PRIME
        return F.struct(t.alias("tree"), h.alias("h"))

    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), hit)
    n = df.count()
    wanted = min(sample, n)
    bound = min(_PRIME, math.ceil(_PRIME * (wanted + 8 * math.sqrt(wanted) + 32) / max(n, 1)))
    while True:
        near = hashed.select(F.explode(F.filter(every, lambda s: s["h"] < bound)).alias("s"), "x", *key)
        drawn = materialize(near.select("s.tree", "s.h", "x", *key), "draws")
        short = drawn.groupBy("tree").count().where(F.col("count") >= wanted).count() < trees
        if bound == _PRIME or not short:
            break
        bound = min(_PRIME, 2 * bound)
    first = Window.partitionBy("tree").orderBy("h", *key)
    ranked = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample)
    return ranked.select("tree", "x", F.lit(wanted).alias("n"))


def _splittable(low: Column, high: Column, dims: int) -> Column:
    return F.filter(F.array(*[F.lit(j) for j in range(dims)]), lambda j: F.get(high, j) > F.get(low, j))


def grow_forest(samples: DataFrame, seed: int, dims: int, sample: int) -> DataFrame:
    """(tree, node, feature, cut, size) of all nodes; a leaf has no feature.

    The children of node i are 2i and 2i + 1.  Every depth is one pass of windows over the
    nodes, all within the partitioning by tree, so the whole growth is one shuffle of
    trees x sample rows.
    """
    depths = math.ceil(math.log2(max(sample, 2)))
    rows = samples.repartition("tree").select("tree", "x", "n", F.lit(1).alias("node"), F.array().cast("array<struct<node:int,feature:int,cut:double>>").alias("cuts"))
    for depth in range(depths):
        inside = Window.partitionBy("tree", "node")
        rows = rows.select("*", F.count("*").over(inside).alias("size"), *[f(F.get("x", F.lit(j))).over(inside).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(dims)])
        low, high = (F.array(*[F.col(f"{name}{j}") for j in range(dims)]) for name in ("low", "high"))
        able = _splittable(low, high, dims)
        rows = rows.select("tree", "x", "n", "node", "cuts", "size", low.alias("low"), high.alias("high"), able.alias("able"), F.md5(F.concat_ws(":", F.lit(str(seed)), "tree", "node")).alias("digits"))
        # a tree of fewer rows ends earlier
        splits = (F.col("size") >= 2) & (F.size("able") > 0) & (F.lit(2**depth) < F.col("n"))
        feature = F.when(splits, F.get("able", (_hex(F.col("digits"), 1, 7) % F.size("able")).cast("int")))
        share = _hex(F.col("digits"), 8, 13).cast("double") / float(1 << 52)
        rows = rows.withColumn("feature", feature)
        rows = rows.withColumn("cut", F.get("low", "feature") + (F.get("high", "feature") - F.get("low", "feature")) * share)
        right = (F.get("x", "feature") > F.col("cut")).cast("int")
        found = F.array(F.struct("node", "feature", "cut"))
        rows = rows.select(
            "tree", "x", "n",
            F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + right).alias("node"),
            F.when(F.col("feature").isNull(), F.col("cuts")).otherwise(F.concat("cuts", found)).alias("cuts"),
        )
    grown = materialize(rows.select("tree", "node", "cuts"), "grown")
    inner = grown.select("tree", F.inline("cuts")).distinct().withColumn("size", F.lit(None).cast("bigint"))
    leaves = grown.groupBy("tree", "node").agg(F.count("*").alias("size"))
    none = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("cut")]
    return inner.unionByName(leaves.select("tree", "node", *none, "size"))


def forest_score(nodes: DataFrame, cols: Sequence[str], trees: int, sample: int) -> Column:
    """Score column: -2^(-mean path / expected path), lower is more abnormal.

    The node table has at most 2 * trees * sample rows, whatever the input: it is
    read once and travels with the scoring function.
    """
    table = nodes.toPandas()
    depths = math.ceil(math.log2(max(sample, 2)))
    slots = 1 << (depths + 1)
    tree, node = (table[c].to_numpy(dtype="int64") for c in ("tree", "node"))
    inner = table["size"].isna().to_numpy()
    feature = np.full((trees, slots), -1)
    cut = np.zeros((trees, slots))
    # a child that no row of the sample reached is an empty leaf
    depth = np.floor(np.log2(np.maximum(np.arange(slots), 1)))
    length = np.tile(np.rint(depth * _UNITS).astype("int64"), (trees, 1))
    feature[tree[inner], node[inner]] = table["feature"].to_numpy(dtype="float64")[inner].astype("int64")
    cut[tree[inner], node[inner]] = table["cut"].to_numpy(dtype="float64")[inner]
    size = table["size"].to_numpy(dtype="float64")[~inner]
    at = (tree[~inner], node[~inner])
    length[at] = np.rint((depth[at[1]] + mean_path(size)) * _UNITS).astype("int64")
    drawn = size[tree[~inner] == 0].sum() if len(size) else 0.0
    expected = float(mean_path(drawn))

    @pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        total = np.zeros(len(x), dtype="int64")
        every = np.arange(len(x))
        for t in range(trees):
            node = np.ones(len(x), dtype="int64")
            for _ in range(depths):
                f = feature[t, node]
                right = x[every, np.maximum(f, 0)] > cut[t, node]
                node = np.where(f < 0, node, 2 * node + right)
            total += length[t, node]
        if not expected:
            return pd.Series(np.full(len(x), -1.0))
        return pd.Series(-np.exp2(-(total / _UNITS / trees) / expected))

    return score(*filled(cols))


def isolation_forest(
    df: DataFrame,
    cols: Sequence[str],
    key: Sequence[str],
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
    contamination: float = 0.05,
) -> DataFrame:
    """Add if_score and if_anomaly.  ``df`` is read three times; ``key`` is unique."""
    samples = sample_rows(df, cols, key, trees, sample, seed)
    nodes = grow_forest(samples, seed, len(cols), sample)
    scored = materialize(df.withColumn("if_score", forest_score(nodes, cols, trees, sample)), "forest")
    return flag_below(scored, "if_score", "if_anomaly", contamination)
