"""Properties of the isolation forest."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators.forest import grow_forest, isolation_forest, mean_path, sample_rows

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 4))
    x[:6] += 40 * np.sign(x[:6])
    return [(i, *map(float, v)) for i, v in enumerate(x)]


def _scores(spark, rows, parts, **kw):
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    found = isolation_forest(df.repartition(parts), COLS, ["id"], **kw)
    return {r.id: (r.if_score, r.if_anomaly) for r in found.collect()}


def test_scores_do_not_depend_on_partitioning(spark, rows):
    a = _scores(spark, rows, 2)
    b = _scores(spark, rows[::-1], 7)
    assert a == b and len(a) == 600
    assert all(-1.0 <= s < 0.0 for s, _ in a.values())
    planted = sorted(a, key=lambda i: a[i][0])[:6]
    assert set(planted) == set(range(6))
    assert sum(f for _, f in a.values()) == 30  # strictly below the 5 % quantile of 600
    other = _scores(spark, rows, 3, seed=7)
    assert other != a


def _plain(rows, trees, sample, seed):
    """(scores, nodes) by loops over the rows: draws, cuts and walks as they are described."""
    prime = (1 << 31) - 1
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    n = min(sample, len(rows))
    marks = {r[0]: int(md5(f"{seed}|{r[0]}")[:8], 16) % prime for r in rows}
    total, nodes = {r[0]: 0 for r in rows}, []
    for t in range(trees):
        h = md5(f"{seed}:{t}")
        a, b = 1 + int(h[:8], 16) % (prime - 1), int(h[8:16], 16) % prime
        drawn = sorted(rows, key=lambda r: ((a * marks[r[0]] + b) % prime, r[0]))[:n]

        def grow(node, part, depth):
            low, high = ([f(r[1 + j] for r in part) for j in range(4)] if part else [0] * 4 for f in (min, max))
            able = [j for j in range(4) if high[j] > low[j]]
            if len(part) < 2 or not able or 2**depth >= n:
                nodes.append((t, node, None, None, len(part)))
                return depth + float(mean_path(len(part)))
            d = md5(f"{seed}:{t}:{node}")
            j = able[int(d[:7], 16) % len(able)]
            cut = low[j] + (high[j] - low[j]) * (int(d[7:20], 16) / float(1 << 52))
            nodes.append((t, node, j, cut, None))
            left, right = ([r for r in part if (r[1 + j] > cut) == side] for side in (False, True))
            return j, cut, grow(2 * node, left, depth + 1), grow(2 * node + 1, right, depth + 1)

        tree = grow(1, drawn, 0)
        for r in rows:
            at = tree
            while isinstance(at, tuple):
                at = at[3 if r[1 + at[0]] > at[1] else 2]
            total[r[0]] += round(at * 1e9)
    expected = float(mean_path(n))
    return {i: -(2 ** (-(v / 1e9 / trees) / expected)) for i, v in total.items()}, nodes


@pytest.mark.parametrize("sample", [16, 256, 1000])
def test_trees_and_scores_match_plain_loops(spark, rows, sample):
    trees, seed = 8, 11
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double").repartition(5)
    samples = sample_rows(df, COLS, ["id"], trees, sample, seed)
    sizes = {r["tree"]: r["count"] for r in samples.groupBy("tree").count().collect()}
    assert sizes == {t: min(sample, 600) for t in range(trees)}
    want, nodes = _plain(rows, trees, sample, seed)
    found = grow_forest(samples, seed, 4, sample).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((t, i, j, c, s) for t, i, j, c, s in nodes if s != 0), key=str)
    got = _scores(spark, rows, 3, trees=trees, sample=sample, seed=seed)
    assert {i: round(s, 9) for i, (s, _) in got.items()} == {i: round(s, 9) for i, s in want.items()}


def test_draws_come_from_all_rows(spark, rows):
    """However small the samples are, no row is out of reach of all trees."""
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    drawn = sample_rows(df.withColumn("id2", df.id), COLS, ["id"], 400, 8, 1).withColumn("first", F.get("x", F.lit(0)))
    assert drawn.select("first").distinct().count() > 0.98 * len(rows)


def test_copies_cannot_be_split(spark):
    rows = [(i, 1.0, 2.0, 3.0, 4.0) for i in range(50)]
    scores = _scores(spark, rows, 2)
    assert len({s for s, _ in scores.values()}) == 1
    assert sum(f for _, f in scores.values()) == 0


def test_no_and_few_rows(spark):
    assert _scores(spark, [], 2) == {}
    assert {s for s, _ in _scores(spark, [(1, 1.0, 2.0, 3.0, 4.0)], 1).values()} == {-1.0}


def test_mean_path_values():
    assert mean_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    want = 2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256
    assert mean_path(256) == pytest.approx(want)
