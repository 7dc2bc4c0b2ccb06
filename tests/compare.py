"""Comparing a Spark result with a DuckDB result as sets of rows."""

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs, empty if nothing does."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = _rows(names, found.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}"]
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return [f"{len(bad)} of {len(want)} rows: {bad[0][0]} != {bad[0][1]}"] if bad else []
