"""k nearest neighbours in space partitions, exact or by random projections, and the Local Outlier Factor.

Copies of a point are collapsed first, so a location shared by a third of the rows
is one point with a weight.  The points are cut into leaves of similar size, level by
level: one grouped pass gives every cell its bounding box and an approximate median per
dimension, and cells that are too large are halved along their widest side.  The cells
are a table; nothing of the size of the points reaches the driver.

A leaf finds neighbours among its own points, which bounds the distance to the true ones.
Points whose ball meets the bounding box of other leaves first ask the nearest of these,
which shrinks the ball, and then all that it still meets.  No pair of rows is formed
outside a leaf.  Leaves that are close together share a block, of ``LEAF_ROWS`` points at
most, which one task cuts, searches and asks; the way from a ball to its leaves goes down
the tree of cells a few levels at a time.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.operators.matrix import filled
from panelspark.operators.thresholds import flag_below
from panelspark.session import materialize

LEAF_ROWS = 4096
_BLOCK = 200_000  # distances held at once in a task; they stay in the cache
_ACCURACY = 200  # of the medians: they only decide where cells are cut
_TOP_LEVELS = 12  # of the tree of cells, whose boxes travel with a function
_STEP_LEVELS = 3  # of the tree below them that a ball goes down in one join
_ASKS = 65_536  # of a block that one task answers
_FIRST = 2  # leaves asked in the first round

_EDGE = "nbr bigint, d double, w bigint"
_NBRS = f"array<struct<{_EDGE}>>"


def _norm(differences) -> np.ndarray:
    """Euclidean length from one array per dimension, summed in that order."""
    total = None
    for difference in differences:
        square = difference * difference
        total = square if total is None else total + square
    return np.sqrt(total)


def _nearest(
    x: np.ndarray, ids: np.ndarray, px: np.ndarray, pid: np.ndarray, pm: np.ndarray, k: int
) -> Iterator[tuple]:
    """Blocks (row of x, row of px, distance, weight) of each point's k nearest rows.

    ``pid`` ascends.  Neighbours come by distance, then id; the weights add up to
    k, or to all there are; the point itself stands for its other copies.
    """
    step = max(1, _BLOCK // len(px))
    keep = min(k, len(px) - 1)  # k other points, and the point itself
    for start in range(0, len(x), step):
        q = x[start : start + step]
        d = _norm(q[:, None, j] - px[None, :, j] for j in range(x.shape[1]))
        bound = np.partition(d, keep, axis=1)[:, keep]
        row, col = np.nonzero(d <= bound[:, None])
        dist = d[row, col]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        w = pm[col] - (pid[col] == ids[start + row])
        upto = np.cumsum(w)
        first = np.searchsorted(row, row)  # where the row's neighbours begin
        before = upto - w - (upto[first] - w[first])
        take = np.minimum(w, k - before)
        used = take > 0
        yield start + row[used], col[used], dist[used], take[used]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _points(table: pa.Table, name: str = "x") -> np.ndarray:
    return np.stack(table[name].to_numpy(zero_copy_only=False))


def _by_id(table: pa.Table) -> pa.Table:
    return table.sort_by("id")


def _edges(ids: np.ndarray, n: int, row: np.ndarray, nbr: np.ndarray, d: np.ndarray, w: np.ndarray) -> pa.Table:
    """(id, nbrs) from neighbours in the order of their rows."""
    edges = pa.StructArray.from_arrays([pa.array(nbr), pa.array(d), pa.array(w.astype("int64"))], names=["nbr", "d", "w"])
    return pa.table({"id": pa.array(ids), "nbrs": pa.ListArray.from_arrays(_offsets(row, n), edges)})


def _leaf_runs(leaf: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(leaf, start, stop) of the runs of an ascending column."""
    cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
    yield from ((int(leaf[a]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _search_leaves(k: int):
    """(id, nbrs) within each leaf of a block."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("id", "ascending")])
        ids, m, leaf = _columns(table, "id", "m", "leaf")
        x = _points(table)
        found = []
        for _, a, b in _leaf_runs(leaf):
            for row, col, dist, w in _nearest(x[a:b], ids[a:b], x[a:b], ids[a:b], m[a:b], k):
                found.append((row + a, col + a, dist, w))
        row, col, dist, w = (np.concatenate(part) for part in zip(*found))
        return _edges(ids, len(ids), row, ids[col], dist, w)

    return search


def _offsets(row: np.ndarray, n: int) -> pa.Array:
    ends = np.cumsum(np.bincount(row, minlength=n))
    return pa.array(np.concatenate([[0], ends]).astype("int32"))


def _answer_asks(k: int):
    """(id, nbr, d, w) for points that ask leaves of a block, within their radius."""

    def answer(asks: pa.Table, points: pa.Table) -> pa.Table:
        names = ["id", "nbr", "d", "w"]
        empty = [np.empty(0, t) for t in ("int64", "int64", "float64", "int64")]
        if not asks.num_rows or not points.num_rows:
            return pa.table([pa.array(c) for c in empty], names=names)
        asks, points = asks.sort_by("leaf"), points.sort_by([("leaf", "ascending"), ("id", "ascending")])
        ids, r, wanted = _columns(asks, "ask", "r", "leaf")
        pid, m, leaf = _columns(points, "id", "m", "leaf")
        at, x = _points(asks, "at"), _points(points)
        found = [empty]
        for cell, a, b in _leaf_runs(wanted):
            p, q = np.searchsorted(leaf, [cell, cell + 1])
            for row, col, dist, w in _nearest(at[a:b], ids[a:b], x[p:q], pid[p:q], m[p:q], k):
                near = dist <= r[a + row]
                found.append((ids[a + row[near]], pid[p + col[near]], dist[near], w[near].astype("int64")))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    return answer


def distinct_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(id, x, m): the distinct feature vectors with their number of rows.

    Ids ascend in the order of the vectors, so breaking ties by id does not depend
    on the partitioning; they are fixed by writing the table down.
    """
    counted = df.groupBy(F.array(*filled(cols)).alias("x")).agg(F.count("*").alias("m"))
    in_order = counted.orderBy(*[F.col("x")[i] for i in range(len(cols))])
    return materialize(in_order.withColumn("id", F.monotonically_increasing_id()), "points")


def _cut_block(leaf_rows: int):
    """The points of a cell with their leaves below it, by exact medians."""

    def cut(table: pa.Table) -> pa.Table:
        x = _points(table)
        leaf = np.empty(len(x), "int64")
        todo = [(table["leaf"][0].as_py(), np.arange(len(x)))]
        while todo:
            cell, rows = todo.pop()
            leaf[rows] = cell
            if len(rows) <= leaf_rows:
                continue
            part = x[rows]
            with np.errstate(invalid="ignore"):
                width = part.max(axis=0) - part.min(axis=0)
            side = np.where(width > 0, width, 0.0)  # a width that is no number has no cut
            at = part[:, int(side.argmax())]
            if side.max() > 0:
                middle = np.partition(at, len(at) // 2)[len(at) // 2]
                upper = at > middle if middle == at.min() else at >= middle
                todo += [(2 * cell, rows[~upper]), (2 * cell + 1, rows[upper])]
        return pa.table([*[table[c] for c in ("id", "x", "m")], pa.array(leaf), table["leaf"]], names=["id", "x", "m", "leaf", "block"])

    return cut


def _boxes(placed: DataFrame, dims: int) -> DataFrame:
    at = [F.col("x")[j] for j in range(dims)]
    return placed.groupBy("leaf").agg(
        F.first("block").alias("block"),
        F.count("*").alias("size"),
        F.array(*[F.min(v) for v in at]).alias("low"),
        F.array(*[F.max(v) for v in at]).alias("high"),
    )


def cut_cells(points: DataFrame, dims: int, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points with their leaf and block, and the leaves (leaf, block, size, low, high) with their boxes.

    Cells are numbered like a heap: the halves of cell c are 2c and 2c + 1.  Passes over all
    points cut them into blocks of ``LEAF_ROWS`` (or ``leaf_rows``, if more), tasks these into leaves.
    """
    block_rows = max(leaf_rows, LEAF_ROWS)
    placed = _cut_blocks(points, dims, block_rows)
    if leaf_rows < block_rows:
        ddl = "id bigint, x array<double>, m bigint, leaf bigint, block bigint"
        placed = materialize(placed.groupBy("leaf").applyInArrow(_cut_block(leaf_rows), ddl), "placed")
    else:
        placed = placed.withColumn("block", F.col("leaf"))
    return placed, materialize(_boxes(placed, dims), "leaves")


def _cut_blocks(points: DataFrame, dims: int, leaf_rows: int) -> DataFrame:
    """(id, x, m, leaf): the points in cells of at most ``leaf_rows``."""
    placed = points.select("id", "x", "m", F.lit(1).cast("bigint").alias("leaf"))
    at = [F.col("x")[j] for j in range(dims)]
    while True:
        found = placed.groupBy("leaf").agg(
            F.count("*").alias("size"),
            F.array(*[F.min(v) for v in at]).alias("low"),
            F.array(*[F.max(v) for v in at]).alias("high"),
            F.array(*[F.percentile_approx(v, 0.5, F.lit(_ACCURACY)) for v in at]).alias("middle"),
        )
        cells = materialize(found, "cells")
        # distinct points have a side of some width, unless a width is infinite or no number
        sides = [F.struct((F.col("high")[j] - F.col("low")[j]).alias("width"), F.lit(-j).alias("j")) for j in range(dims)]
        widest = cells.where(F.col("size") > leaf_rows).withColumn("side", F.greatest(*sides) if dims > 1 else sides[0])
        cuts = widest.where("side.width > 0").select(
            F.col("leaf").alias("cell"),
            (-F.col("side.j")).alias("dim"),
            F.get("middle", -F.col("side.j")).alias("cut"),
            (F.get("middle", -F.col("side.j")) == F.get("low", -F.col("side.j"))).alias("lowest"),
        )
        if cuts.isEmpty():
            return placed
        value = F.get("x", F.col("dim"))
        # a median at the lower end goes to the lower half, else to the upper
        upper = F.when(F.col("lowest"), value > F.col("cut")).otherwise(value >= F.col("cut"))
        half = F.when(F.col("cell").isNull(), F.col("leaf")).otherwise(2 * F.col("leaf") + upper.cast("bigint"))
        joined = placed.join(cuts, F.col("leaf") == F.col("cell"), "left")
        placed = materialize(joined.select("id", "x", "m", half.alias("leaf")), "placed")


def _gap(low: Column, high: Column, dims: int) -> Column:
    """Distance of the point x to a box, built like the distance of two points.

    Term by term it is at or below the distance to any point of the box, also when rounded.
    """
    total = None
    for j in range(dims):
        off = F.greatest(F.get(low, F.lit(j)) - F.get("x", F.lit(j)), F.get("x", F.lit(j)) - F.get(high, F.lit(j)), F.lit(0.0))
        total = off * off if total is None else total + off * off
    return F.sqrt(total)


def _upper(cell: str, levels: int) -> Column:
    """The cell above, at most ``levels`` below the root."""
    return F.expr(f"shiftright({cell}, greatest(length(bin({cell})) - 1 - {levels}, 0))")


def _around(cells: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.array(*[F.min(F.col("low")[j]) for j in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("high")[j]) for j in range(dims)]).alias("high"),
    )


def _box_gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _norm(np.maximum(np.maximum(low[None, :, j] - x[:, None, j], x[:, None, j] - high[None, :, j]), 0.0) for j in range(x.shape[1]))


def reached(found: DataFrame, leaves: DataFrame, dims: int) -> DataFrame:
    """(id, x, r, leaf, block, gap): the other leaves whose box the ball of radius r around a point meets.

    The boxes of a bounded number of upper cells travel with the function.  Below those that a
    ball meets it goes down the tree by joins, ``_STEP_LEVELS`` levels each, and keeps the cells it
    meets; so its rows follow the cells met, not all leaves below an upper cell.
    """
    named = leaves.withColumn("top", _upper("leaf", _TOP_LEVELS))
    tops = _around(named, ["top"], dims).collect()
    cells = np.array([t.top for t in tops], "int64")
    low, high = (np.array([t[i] for t in tops], "float64").reshape(-1, dims) for i in (1, 2))
    # the upper cells in groups of about the square root of their number
    above = [c >> max(c.bit_length() - 1 - _TOP_LEVELS // 2, 0) for c in cells.tolist()]
    groups = [np.flatnonzero(np.array(above) == g) for g in sorted(set(above))]
    lows, highs = np.array([low[g].min(axis=0) for g in groups]), np.array([high[g].max(axis=0) for g in groups])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                part = batch.slice(start, 10_000)
                x, r = _points(part), part.column("r").to_numpy()
                near = _box_gaps(x, lows, highs) <= r[:, None]
                rows, tops = [], []
                for i, group in enumerate(groups):
                    at = np.flatnonzero(near[:, i])
                    row, col = np.nonzero(_box_gaps(x[at], low[group], high[group]) <= r[at, None])
                    rows.append(at[row])
                    tops.append(cells[group[col]])
                taken = part.take(pa.array(np.concatenate(rows)))
                yield pa.record_batch([*[taken.column(c) for c in ("id", "own", "x", "r")], pa.array(np.concatenate(tops))], ["id", "own", "x", "r", "top"])

    met = found.select("id", F.col("leaf").alias("own"), "x", "r").mapInArrow(meet, "id long, own long, x array<double>, r double, top long")
    deepest = leaves.agg(F.max(F.expr("length(bin(leaf))")) - 1).first()[0]
    gap = _gap(F.col("low"), F.col("high"), dims)
    for level in range(_TOP_LEVELS + _STEP_LEVELS, deepest, _STEP_LEVELS):
        named = leaves.withColumn("top", _upper("leaf", level - _STEP_LEVELS)).withColumn("next", _upper("leaf", level))
        met = met.join(_around(named, ["top", "next"], dims), "top").where(gap <= F.col("r"))
        met = met.select("id", "own", "x", "r", F.col("next").alias("top"))
        named = leaves.withColumn("top", _upper("leaf", level))
    below = met.join(named.select("top", "leaf", "block", "low", "high"), "top").where("leaf != own")
    return below.select("id", "x", "r", "leaf", "block", gap.alias("gap")).where("gap <= r")


def _answers(asks: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(id, nbr, d, w): what the asked leaves know.

    Many points may ask the same block: its asks are split into parts of at most
    about ``_ASKS``, and each part meets a copy of the block.
    """
    parts = F.ceil(F.count("*") / F.lit(_ASKS)).cast("int")
    loads = asks.groupBy("block").agg(parts.alias("parts"))
    chosen = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    asks = asks.join(loads, "block").select("block", chosen, "leaf", F.col("id").alias("ask"), F.col("x").alias("at"), "r")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    copies = placed.join(loads, "block").select("block", each, "leaf", "id", "x", "m")
    return (
        asks.groupBy("block", "part")
        .cogroup(copies.groupBy("block", "part"))
        .applyInArrow(_answer_asks(k), f"id bigint, {_EDGE}")
    )


def _nearest_of(pooled: DataFrame, k: int) -> DataFrame:
    """Of each point's edges the nearest whose weights add up to k."""
    nearer = Window.partitionBy("id").orderBy("d", "nbr").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(nearer), F.lit(0))
    return pooled.withColumn("w", F.least(F.col("w"), F.lit(k) - before)).where(F.col("w") > 0)


def _radii(edges: DataFrame, k: int) -> DataFrame:
    """(id, r): the distance of the k-th neighbour, infinite while there are fewer."""
    full = F.when(F.sum("w") >= k, F.max("d")).otherwise(float("inf"))
    return edges.groupBy("id").agg(full.alias("r"))


def neighbour_graph(
    points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, report: dict | None = None
) -> DataFrame:
    """Edges (id, nbr, d, w) to the k nearest rows of every point, as a stored table.

    ``report`` receives the number of leaves and of asks.
    """
    first = points.first()
    if first is None:
        return points.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("d"), F.col("m").alias("w"))
    dims = len(first.x)
    placed, leaves = cut_cells(points, dims, leaf_rows)
    inside = placed.groupBy("block").applyInArrow(_search_leaves(k), f"id bigint, nbrs {_NBRS}")
    edges = materialize(inside.select("id", F.inline("nbrs")), "inside")
    n_leaves = leaves.count()
    if report is not None:
        report.update(leaves=n_leaves, asks=0)
    if n_leaves == 1:
        return edges

    asked = None
    for only in (_FIRST, None):
        radii = placed.select("id", "x", "leaf").join(_radii(edges, k), "id", "left").fillna({"r": float("inf")})
        asks = reached(radii, leaves, dims)
        if only is not None:
            near = Window.partitionBy("id").orderBy("gap", "leaf")
            asks = asks.withColumn("place", F.row_number().over(near)).where(F.col("place") <= only).drop("place")
        else:
            asks = asks.join(asked, ["id", "leaf"], "left_anti")
        asks = materialize(asks, "asks")
        if report is not None:
            report["asks"] += asks.count()
        asked = asks.select("id", "leaf")
        pooled = edges.unionByName(_answers(asks, placed, k))
        edges = materialize(_nearest_of(pooled, k), "edges")
    return edges


def _windows(batches: Iterator[pa.RecordBatch], keys: Sequence[str], half: int) -> Iterator[tuple[pa.Table, int, int]]:
    """(rows, start, stop) of each run of equal keys in a sorted stream: each row is once in a
    start to stop, among all rows of the windows of two halves, overlapping by one, that hold it.

    Rows at most ``half`` places apart share a window; two windows are held at a time.
    """
    held, name, before = None, None, 0  # before: rows held for the next ones only

    def last() -> Iterator[tuple[pa.Table, int, int]]:
        first = min(before + half, held.num_rows)
        yield held, before, first
        if first < held.num_rows:
            yield held.slice(before), first - before, held.num_rows - before

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for key in keys:
            column = batch.column(key).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            run = tuple(batch.column(key)[a].as_py() for key in keys)
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if run != name:
                if held is not None:
                    yield from last()
                held, name, before = part, run, 0
            else:
                held = pa.concat_tables([held, part])
            while held.num_rows - before > 3 * half:
                yield held.slice(0, before + 2 * half), before, before + half
                held, before = held.slice(before), half
    if held is not None:
        yield from last()


def approximate_graph(
    points: DataFrame, k: int, tables: int = 12, bucket_rows: int = 256, seed: int = 42
) -> DataFrame:
    """Edges like those of ``neighbour_graph``, by random projections: most, not all of them.

    In each of ``tables`` tables the points are projected on three random lines (each column
    scaled by its spread).  Quantiles on the first two cut them into cells that hold the
    same share of each line; in a cell the points are sorted along the third, and those
    within about ``bucket_rows`` places of each other are candidates, whose distances are
    exact.  A large cell is streamed, so ties and clusters cost no memory.
    """
    first = points.first()
    if first is None:
        return neighbour_graph(points, k)
    dims = len(first.x)
    at = [F.col("x")[j] for j in range(dims)]
    n, *spreads = points.agg(F.count("*"), *[F.stddev_samp(v) for v in at]).first()
    scale = np.array([s if s and np.isfinite(s) else 1.0 for s in spreads])
    lines = np.random.default_rng(seed).normal(size=(tables, 3, dims)) / scale
    slots = max(1, round((n / bucket_rows) ** (1 / 3)))
    shares = F.array(*[F.lit(i / slots) for i in range(1, slots)])

    def place(line: Sequence[float]) -> Column:
        return sum((F.lit(float(c)) * v for c, v in zip(line[1:], at[1:])), F.lit(float(line[0])) * at[0])

    edges = np.empty((tables, 2, slots - 1))
    if slots > 1:
        sketches = [F.percentile_approx(place(lines[t, i]), shares, F.lit(10 * slots)) for t in range(tables) for i in (0, 1)]
        edges = np.array(points.agg(*sketches).first(), dtype="float64").reshape(tables, 2, slots - 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch)
            for t in range(tables):
                on = [sum(c * x[:, j] for j, c in enumerate(line)) for line in lines[t]]
                cell = np.searchsorted(edges[t, 0], on[0]) * slots + np.searchsorted(edges[t, 1], on[1])
                numbers = [pa.array(np.full(len(x), t, "int32")), pa.array(cell.astype("int64")), pa.array(on[2])]
                yield pa.record_batch([*[batch.column(c) for c in ("id", "x", "m")], *numbers], ["id", "x", "m", "t", "cell", "place"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start, stop in _windows(batches, ["t", "cell"], bucket_rows):
            asks, table = table.slice(start, stop - start), _by_id(table)
            ids, (pid, m) = _columns(asks, "id")[0], _columns(table, "id", "m")
            blocks = list(_nearest(_points(asks), ids, _points(table), pid, m, k))
            row, col, dist, w = (np.concatenate(part) for part in zip(*blocks))
            yield from _edges(ids, len(ids), row, pid[col], dist, w).to_batches()

    ddl = "id long, x array<double>, m long, t int, cell long, place double"
    projected = points.select("id", "x", F.col("m").cast("bigint").alias("m")).mapInArrow(project, ddl)
    dealt = projected.repartition("t", "cell").sortWithinPartitions("t", "cell", "place", "id")
    found = dealt.mapInArrow(search, f"id bigint, nbrs {_NBRS}").select("id", F.inline("nbrs"))
    # one edge found several times is one; a window without the point's copies knows fewer
    found = found.groupBy("id", "nbr").agg(F.min("d").alias("d"), F.max("w").alias("w"))
    return materialize(_nearest_of(found, k), "edges")


def outlier_factors(edges: DataFrame) -> DataFrame:
    """(id, lof): negative ratio of the neighbours' density to the point's own.

    A point is the neighbour of a bounded number of distinct points, so the joins
    on the neighbour have no hot key.
    """
    def weighted(c: Column) -> Column:
        return F.sum(F.col("w") * c) / F.sum("w")

    reach = edges.groupBy("id").agg(F.max("d").alias("kdist"))
    reach = reach.withColumnRenamed("id", "nbr")
    within = F.greatest("kdist", "d")
    density = edges.join(reach, "nbr").groupBy("id").agg(
        (F.lit(1.0) / (weighted(within) + F.lit(1e-10))).alias("density")
    )
    near = edges.join(density.withColumnRenamed("id", "nbr"), "nbr")
    around = near.groupBy("id").agg(weighted(F.col("density")).alias("around"))
    return around.join(density, "id").select("id", (-F.col("around") / F.col("density")).alias("lof"))


def local_outlier_factor(
    df: DataFrame,
    cols: Sequence[str],
    k: int = 20,
    contamination: float = 0.05,
    leaf_rows: int = LEAF_ROWS,
    method: str = "exact",
) -> DataFrame:
    """Add lof_score (lower is more abnormal) and lof_anomaly.

    Missing values count as 0.0.  Neighbours at equal distance are taken in the
    order of their vectors.  ``method`` is ``exact`` or ``lsh``, where neighbours come
    from random projections and some are missed.  ``df`` is read twice.
    """
    if method not in ("exact", "lsh"):
        raise ValueError("method must be exact or lsh")
    points = distinct_points(df, cols)
    graph = neighbour_graph(points, k, leaf_rows) if method == "exact" else approximate_graph(points, k)
    factors = outlier_factors(graph)
    scores = points.join(factors, "id", "left").select("x", "lof")
    scores = scores.withColumnsRenamed({"x": "_x", "lof": "lof_score"})
    x = F.array(*filled(cols))
    scored = df.withColumn("_x", x).join(scores, "_x", "left").drop("_x")
    return flag_below(materialize(scored, "lof"), "lof_score", "lof_anomaly", contamination)
