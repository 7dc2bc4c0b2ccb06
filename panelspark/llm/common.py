"""Shared pieces of the text operators: words, inputs, sorted streams, row sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and line rule here: space, tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = "[ \\t-\\r]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also inside lambdas.

    A lambda body that names a plain expression computes it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    trimmed = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * 6))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys of a stream sorted by them; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield held_key, pa.Table.from_batches(held)


def sorted_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]
) -> Iterator[list[np.ndarray]]:
    """Like ``sorted_groups`` for number columns: the value arrays of each run of two rows or more."""
    held: list[list[np.ndarray]] = []
    held_key: tuple = ()

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        arrays = [batch.column(v).to_numpy(zero_copy_only=False) for v in values]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        if held and held_key != tuple(c[0] for c in columns):
            yield from [run for run in [joined()] if len(run[0]) > 1]
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            if held:
                held.append([x[a:b] for x in arrays])
                yield joined()
                held = []
            elif b - a > 1:
                yield [x[a:b] for x in arrays]
        held.append([x[cuts[-2] :] for x in arrays])
        held_key = tuple(c[-1] for c in columns)
    if held:
        yield from [run for run in [joined()] if len(run[0]) > 1]


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches with their texts as Python strings, null as empty, a few MB at a time."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(sizes.astype(float)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + 4_000_000, "right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = stop


def worker_cache(name: str) -> dict:
    """A dictionary of this worker process, kept between batches and tasks."""
    import sys
    import types

    held = sys.modules.setdefault("_panelspark_worker", types.ModuleType("_panelspark_worker"))
    return held.__dict__.setdefault(name, {})


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; on the driver, as parsing needs the session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of Python rows."""
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
