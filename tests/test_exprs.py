"""Arithmetic, labels and crosswalks on hand values."""

import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.functions import exprs, labels
from panelspark.functions.crosswalk import HEADING_RULES, crosswalk_join, map_heading, map_metric


def _one(spark, col, **values):
    df = spark.range(1)
    for name, value in values.items():
        kind = "string" if isinstance(value, str) else "double"
        df = df.withColumn(name, F.lit(value).cast(kind))
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "value, digits, want",
    [(1.005, 2, 1.0), (-2.5, 0, -3.0), (2.5, 0, 3.0), (None, 2, None), (3265542.8049999997, 2, 3265542.81)],
)
def test_rounding(spark, value, digits, want):
    assert _one(spark, exprs.round_mul("v", digits), v=value) == want


def test_ratios_guard_zero_and_null(spark):
    assert _one(spark, exprs.safe_ratio("a", "b"), a=1.0, b=0.0) is None
    assert _one(spark, exprs.safe_ratio("a", "b"), a=1.0, b=None) is None
    assert _one(spark, exprs.net_pct_gni("r", "c", "g"), r=12.0, c=7.0, g=0.0) is None
    assert _one(spark, exprs.absorption_rate("a", "e"), a=3.0, e=0.0) is None


def test_sign_of_net_position(spark):
    values = dict(r=12.0, c=7.0, g=200.0)
    net = exprs.net_position("r", "c")
    assert _one(spark, net, **values) == 5.0
    assert _one(spark, exprs.net_pct_gni("r", "c", "g"), **values) == 2.5
    assert _one(spark, labels.net_status(net), **values) == "receiver"
    assert _one(spark, labels.net_status("v"), v=-1.0) == "contributor"


def test_sums_are_exact_and_order_free(spark):
    random.seed(1)
    values = [round(random.uniform(-1e9, 1e9), 4) for _ in range(4000)] + [1e13, -1e13, 4e15, 1e16, 0.0001]
    want = float(sum(Decimal(repr(v)) for v in values))
    for parts in (1, 7):
        random.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(parts)
        row = df.agg(exprs.exact_sum("v", 4).alias("s"), exprs.mean_of_rows("v", 4).alias("a")).first()
        assert row.s == want and row.a == want / len(values)
    empty = spark.createDataFrame([(None,)], "v double").agg(exprs.exact_sum("v", 4).alias("s"))
    assert empty.first().s is None


def test_amount_out_of_range_fails(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1e300,)], "v double").agg(exprs.exact_sum("v", 4)).collect()


def test_sums_do_not_round_their_input(spark):
    fine = spark.range(100_000).select(F.lit(0.00003).alias("v"))
    row = fine.agg(exprs.total_of("v").alias("s"), exprs.mean_of_rows("v").alias("a"), exprs.exact_sum("v", 5).alias("e")).first()
    assert row.s == pytest.approx(3.0) and row.a == pytest.approx(3e-5) and row.e == 3.0
    with pytest.raises(PySparkException):
        fine.agg(exprs.exact_sum("v", 4)).collect()


def test_flags_and_bands(spark):
    assert _one(spark, labels.zscore_flag("z"), z=None) == 0
    assert _one(spark, labels.zscore_flag("z"), z=-2.5) == 1
    assert _one(spark, labels.zscore_flag("z"), z=2.0) == 0
    assert [_one(spark, labels.severity_band("z"), z=z) for z in (None, 1.0, -2.5, 3.5)] == [
        None, "normal", "anomaly", "extreme"]
    assert [_one(spark, labels.absorption_band("r"), r=r) for r in (None, 80.0, 90.0, 100.0, 101.0)] == [
        None, "under", "normal", "full", "correction"]
    years = [1999, 2000, 2007, 2020, 2027]
    assert [_one(spark, labels.mff_period("y"), y=float(y)) for y in years] == [
        None, "2000-2006", "2007-2013", "2014-2020", "2021-2027"]
    assert _one(spark, labels.policy_event("y"), y=2008.0) == "Financial Crisis (2008)"
    assert [_one(spark, labels.accession_cohort("c"), c=c) for c in ("DE", "PL", "RO", "HR", "XX")] == [
        "EU15", "EU25", "EU27", "EU28", None]
    assert len(labels.COUNTRIES) == len(set(labels.COUNTRIES)) == 28
    text = labels.anomaly_label("c", F.lit(2010), "h")
    assert _one(spark, text, c="PL", h="Internal / Single Market") == "PL 2010\nInternal / Single Ma"


LABELS = {
    "2. Structural actions": "Structural & Cohesion",
    "Sustainable growth: natural resources": "Agriculture & Rural Dev",  # the earlier rule wins
    "5. ADMINISTRATION": "Administration",
    "NextGenerationEU": "NGEU Recovery",
    "Other": None,
    "": None,
}


def test_crosswalk_first_rule_wins(spark):
    for label, want in LABELS.items():
        assert _one(spark, map_heading("s"), s=label) == want
    assert _one(spark, map_metric("s"), s="Total national contribution (incl. VAT)") == "total_contributions"
    assert _one(spark, map_metric("s"), s="Net VAT-based own resource") == "vat_contribution"
    rules = spark.createDataFrame(
        [(i, k, v) for i, (k, v) in enumerate(HEADING_RULES)][::-1], "ordinal int, key string, value string"
    )
    df = spark.createDataFrame([(k,) for k in LABELS] + [(None,)], "label string")
    got = {r.label: r.heading for r in crosswalk_join(df, "label", rules).collect()}
    assert got == {**LABELS, None: None}


def test_crosswalk_of_many_rules(spark):
    rules = spark.range(30_000).selectExpr("CAST(id AS INT) AS ordinal", "concat('Key', id) AS key", "id AS value")
    rows = [("a KEY29999 b",), ("key12 and key7",), ("key",), ("",), (None,), ("x key5",), ("x key5",)]
    df = spark.createDataFrame(rows, "label string")
    got = sorted((r.label or "-", r.heading) for r in crosswalk_join(df, "label", rules).collect() if r.heading is not None)
    # key2 is a piece of key29999 and comes first, as key1 of key12
    assert got == [("a KEY29999 b", 2), ("key12 and key7", 1), ("x key5", 5), ("x key5", 5)]
    assert crosswalk_join(df, "label", rules).count() == len(rows)
    every = spark.createDataFrame([(0, "", 9)], "ordinal int, key string, value int")
    assert [r.heading for r in crosswalk_join(df, "label", every).where("label = ''").collect()] == [9]
