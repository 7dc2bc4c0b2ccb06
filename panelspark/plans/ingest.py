"""From a grid of sheets to the two typed long tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelspark.functions.crosswalk import HEADING_RULES, METRIC_RULES, Rules
from panelspark.functions.labels import COUNTRIES
from panelspark.operators.ingest import (
    concat_sheets,
    layout_of,
    unpivot_expenditure,
    unpivot_revenue,
)
from panelspark.schemas import EXPENDITURE, REVENUE, enforce_schema
from panelspark.session import materialize
from panelspark.sources.cells import select_year_sheets


def parse_sheets(
    cells: DataFrame,
    entities: Sequence[str] = COUNTRIES,
    heading_rules: Rules = HEADING_RULES,
    metric_rules: Rules = METRIC_RULES,
    keys: Sequence[str] = ("BE", "DE", "Total"),
    revenue_after: int = 40,
    preliminary_year: int = 2024,
) -> tuple[DataFrame, DataFrame]:
    """(expenditure, revenue) of all year sheets.

    The text cells are scanned once for the layout of all sheets, the number cells once
    per block.
    """
    sheets = select_year_sheets(cells)
    parts = layout_of(sheets, entities, heading_rules, keys, revenue_after)
    exp = unpivot_expenditure(sheets, entities, heading_rules, preliminary_year, keys, parts)
    rev = unpivot_revenue(sheets, entities, metric_rules, revenue_after, keys, parts)
    exp, rev = concat_sheets(materialize(exp, "expenditure"), rev)
    return enforce_schema(exp, EXPENDITURE), enforce_schema(rev, REVENUE)
