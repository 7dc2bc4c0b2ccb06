"""Parsing a hand-made grid of sheets, and what disturbs it."""

import pytest
from pyspark.errors import PySparkException

from panelspark.functions.crosswalk import HEADING_RULES
from panelspark.functions.labels import COUNTRIES
from panelspark.operators import ingest
from panelspark.plans.ingest import parse_sheets
from panelspark.schemas import CELL, EXPENDITURE, REVENUE, enforce_schema
from panelspark.session import new_path
from panelspark.sources.cells import read_cells, select_year_sheets
from panelspark.sources.sinks import write_table


def _cells(spark, sheets):
    rows = []
    for sheet, grid in sheets.items():
        for row_no, row in grid.items():
            for col_no, value in enumerate(row):
                if value is not None:
                    text = isinstance(value, str)
                    rows.append((sheet, row_no, col_no, value if text else None, None if text else float(value)))
    return spark.createDataFrame(rows, CELL)


def _year_sheet():
    return {
        0: ["EU budget", None, None, None],
        2: [None, None, None, None, "BE ", "DE", "FR", "Total", "of which earmarked"],
        3: [None, "1. Agriculture", None, None, 10, 20.00005, "n/a", 30, 100],
        4: [None, "Sustainable growth", None, None, 1, 2, 3, 0, 100],  # total 0
        5: [None, "Heading", None, None, 1, 2, 3, 6, 100],  # no rule
        6: [" ", "Unknown", "Administration", None, 5, 6, 7, 18],  # no earmark
        8: ["NextGenerationEU"],
        9: [None, "Global Europe", None, None, 8, None, 9, 17, 50],
        20: ["\trevenue ", None],
        21: [None, "Administration", None, None, 5, 5, 5, 15, 5],  # below the section
        45: [None, None, None, None, None, "FR", "BE", "DE", "Total"],
        46: ["VAT-based own resource", None, None, None, None, 1, 2, 3, 6],
        47: ["Customs duties", None, None, None, None, None, 5, 6, 11],
        48: ["Traditional own resources", None, None, None, None, 7, 8, 9, 24],
    }


def _parse(spark, sheets):
    exp, rev = parse_sheets(_cells(spark, sheets).repartition(4))
    assert exp.columns == EXPENDITURE.fieldNames() and rev.columns == REVENUE.fieldNames()
    return exp.collect(), rev.collect()


def test_sheet(spark):
    exp, rev = _parse(spark, {"2020": _year_sheet(), "Notes": {0: ["BE", "DE", "Total"]}})
    got = {(r.country, r.heading, r.actual_meur, r.earmarked_meur, r.is_ngeu) for r in exp}
    assert got == {
        ("BE", "Agriculture & Rural Dev", 10.0, 100.0, 0),
        ("DE", "Agriculture & Rural Dev", 20.0001, 100.0, 0),
        ("BE", "Administration", 5.0, 0.0, 0),
        ("DE", "Administration", 6.0, 0.0, 0),
        ("FR", "Administration", 7.0, 0.0, 0),
        ("BE", "External & Global", 8.0, 50.0, 1),
        ("FR", "External & Global", 9.0, 50.0, 1),
    }
    assert {r.year for r in exp} == {2020} and {r.is_preliminary for r in exp} == {0}
    assert {r.heading_raw for r in exp} == {"1. Agriculture", "Administration", "Global Europe"}
    assert {(r.country, r.metric, r.value_meur, r.row_no) for r in rev} == {
        ("FR", "vat_contribution", 1.0, 46), ("BE", "vat_contribution", 2.0, 46), ("DE", "vat_contribution", 3.0, 46),
        ("BE", "customs", 5.0, 47), ("DE", "customs", 6.0, 47),
        ("FR", "customs", 7.0, 48), ("BE", "customs", 8.0, 48), ("DE", "customs", 9.0, 48),
    }


def test_header_fallback_and_missing_terminator(spark):
    sheet = {k: v for k, v in _year_sheet().items() if k < 20}
    sheet[30] = ["Gross National Income", None, None, None, 1, 2, 3]
    sheet[31] = [None, "Security and defence", None, None, 4, None, None, 4]
    exp, rev = _parse(spark, {"2024": sheet})
    assert {(r.country, r.metric, r.value_meur) for r in rev} == {
        ("BE", "gni_size", 1.0), ("DE", "gni_size", 2.0), ("FR", "gni_size", 3.0)}
    late = [r for r in exp if r.heading == "Security & Citizenship"]
    assert [(r.country, r.is_ngeu, r.is_preliminary) for r in late] == [("BE", 1, 1)]


def test_last_duplicate_header_key_wins(spark):
    sheet = _year_sheet()
    sheet[2] = [None, None, None, None, "BE", "DE", "BE", "Total"]
    exp, _ = _parse(spark, {"2020": sheet})
    assert {(r.country, r.actual_meur) for r in exp if r.heading == "Administration"} == {("BE", 7.0), ("DE", 6.0)}


def test_sheet_without_expenditure_gives_no_revenue(spark):
    empty = {k: v for k, v in _year_sheet().items() if k not in (3, 6, 9)}
    exp, rev = _parse(spark, {"2019": empty, "2020": _year_sheet()})
    assert {r.year for r in exp} == {2020} and {r.year for r in rev} == {2020}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_cells_round_trip(spark, fmt):
    cells = _cells(spark, {" 2001": _year_sheet(), "x": {0: ["a"]}})
    path = new_path(spark, "cells")
    write_table(cells, path, fmt)
    back = read_cells(spark, path, fmt)
    if fmt == "parquet":  # CSV drops the white space around text
        assert back.exceptAll(cells).count() == 0
    assert back.count() == cells.count()
    assert [r.year for r in select_year_sheets(back).select("year").distinct().collect()] == [2001]


def test_schema_is_enforced(spark):
    rows = [("2020", "A", None, "x", float("nan"), 1.0, 0, 0, 1)]
    schema = "year string, country string, heading_raw string, heading string, actual_meur double, earmarked_meur double, is_ngeu int, is_preliminary int, row_no int"
    row = enforce_schema(spark.createDataFrame(rows, schema), EXPENDITURE).first()
    assert row.year == 2020 and row.actual_meur is None
    bad = spark.createDataFrame([(None, *rows[0][1:])], schema)
    with pytest.raises(PySparkException):
        enforce_schema(bad, EXPENDITURE).collect()


def test_one_scan_of_texts_one_of_numbers(spark):
    cells = _cells(spark, {str(y): _year_sheet() for y in range(2000, 2004)})
    path = new_path(spark, "cells")
    write_table(cells, path)
    cells = select_year_sheets(read_cells(spark, path))
    keys = ("BE", "DE", "Total")
    facts, layout = ingest.layout_of(cells, COUNTRIES, HEADING_RULES, keys)
    assert layout.count() == 4
    plan = ingest.row_facts(cells, COUNTRIES, HEADING_RULES, keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    found = ingest.unpivot_expenditure(cells, COUNTRIES, HEADING_RULES, keys=keys, parts=(facts, layout))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the cells, the facts and the layout twice; with the two of the layout at most four exchanges
    assert plan.count("FileScan") == 4 and plan.count("Exchange hashpartitioning") <= 2
