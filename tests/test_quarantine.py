"""Parting rows by their broken rules."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators.audit import constraint_checks
from panelspark.operators.quarantine import broken_rules, part_rows
from panelspark.session import new_path


def rules():
    return [("positive", F.col("a") > 0), ("named", F.col("b").isNotNull()), ("small", F.col("a") < 100)]


def test_rows_are_parted_and_named(spark):
    rows = [(i - 5, None if i % 7 == 0 else "x") for i in range(120)] + [(None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(3)
    clean, bad, counts = part_rows(df, rules(), new_path(spark, "parted"))
    want = {(a, b): [n for n, broken in (("positive", a is not None and a <= 0), ("named", b is None), ("small", a is not None and a >= 100)) if broken] for a, b in rows}
    assert {(r.a, r.b) for r in clean.collect()} == {k for k, v in want.items() if not v}
    assert {(r.a, r.b): r.broken for r in bad.collect()} == {k: v for k, v in want.items() if v}
    assert clean.columns == df.columns and clean.count() + bad.count() == len(rows)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, constraint_checks(df, rules()).collect()))


def test_no_rows_and_too_many_rules(spark):
    df = spark.createDataFrame([], "a int, b string")
    clean, bad, counts = part_rows(df, rules(), new_path(spark, "parted"))
    assert clean.count() == bad.count() == 0
    assert [r.violations for r in counts.collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        broken_rules(rules() * 21)
