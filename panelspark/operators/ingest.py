"""Parsing a ragged grid of sheets with relational operators.

Text cells are few, so the layout of all sheets (headers, columns, sections, row
labels) is derived from them alone, in one scan: ``row_facts`` sums up each row's texts,
``sheet_layout`` each sheet's rows.  The many number cells are scanned once; they look up
their column in the sheet's map and meet the row labels in one equality join.  A single
sheet may hold most of the cells: nothing is grouped by sheet but partial minima.

``locate_header``, ``column_map``, ``section_marker``, ``section_terminator``,
``first_mapped_label`` and ``first_text_label`` give the single steps.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.crosswalk import Rules, map_heading, map_metric
from panelspark.functions.exprs import column, round_mul
from panelspark.session import materialize

TOTAL, EARMARKED = "__total__", "__earmarked__"
_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(column(c), F.lit(_SPACES))


def text_cells(cells: DataFrame) -> DataFrame:
    """Non-blank text cells, stripped."""
    text = cells.where(F.col("s").isNotNull()).withColumn("s", strip("s"))
    return text.where(F.col("s") != "")


def header_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (sheet, row_no) whose cells include every key."""
    text = strip("s")
    found = [F.max((text == key).cast("int")).alias(f"k{i}") for i, key in enumerate(keys)]
    rows = cells.where(text.isin(*keys)).groupBy("sheet", "row_no").agg(*found)
    every = " AND ".join(f"k{i} = 1" for i in range(len(keys)))
    return rows.where(every).select("sheet", "row_no")


def locate_header(
    cells: DataFrame, keys: Sequence[str] = ("BE", "DE", "Total"), after: int = 0
) -> DataFrame:
    """First header row of each sheet, at ``after`` or below: (sheet, header_row)."""
    rows = header_rows(cells, keys).where(F.col("row_no") >= after)
    return rows.groupBy("sheet").agg(F.min("row_no").alias("header_row"))


def revenue_header(
    cells: DataFrame, keys: Sequence[str] = ("BE", "DE", "Total"), after: int = 40
) -> DataFrame:
    """Header of the second block; a sheet without one reuses its first header."""
    late = F.min(F.when(F.col("row_no") >= after, F.col("row_no")))
    header = F.coalesce(late, F.min("row_no")).alias("header_row")
    return header_rows(cells, keys).groupBy("sheet").agg(header)


def column_map(
    cells: DataFrame,
    header: DataFrame,
    entities: Sequence[str],
    total: str = "Total",
    earmark_like: str = "earmarked",
) -> DataFrame:
    """Column of each key per sheet, the last match wins: (sheet, key, col_no)."""
    key = _column_key(strip("s"), entities, total, earmark_like)
    named = cells.withColumn("key", key).where(F.col("key").isNotNull())
    at = header.withColumnRenamed("header_row", "row_no")
    return (
        named.join(at, ["sheet", "row_no"])
        .groupBy("sheet", "key")
        .agg(F.max("col_no").alias("col_no"))
    )


def section_marker(cells: DataFrame, like: str = "nextgenerationeu") -> DataFrame:
    """First row of each sheet with the text in any cell: (sheet, marker_row)."""
    hit = cells.where(F.lower("s").contains(like))
    return hit.groupBy("sheet").agg(F.min("row_no").alias("marker_row"))


def section_terminator(
    cells: DataFrame, header: DataFrame, text: str = "REVENUE", first_cols: int = 3
) -> DataFrame:
    """First row below the header that ends the section: (sheet, end_row)."""
    hit = cells.where((F.col("col_no") < first_cols) & (F.upper(strip("s")) == text))
    below = hit.join(header, "sheet").where(F.col("row_no") > F.col("header_row"))
    return below.groupBy("sheet").agg(F.min("row_no").alias("end_row"))


def first_mapped_label(cells: DataFrame, rules: Rules, first_cols: int = 4) -> DataFrame:
    """Leftmost label of a row that maps: (sheet, row_no, heading_raw, heading)."""
    text = text_cells(cells.where(F.col("col_no") < first_cols))
    mapped = text.withColumn("heading", map_heading("s", rules))
    label = F.min_by(F.struct("s", "heading"), "col_no")
    return (
        mapped.where(F.col("heading").isNotNull())
        .groupBy("sheet", "row_no")
        .agg(label.alias("label"))
        .select(
            "sheet",
            "row_no",
            F.col("label.s").alias("heading_raw"),
            F.col("label.heading").alias("heading"),
        )
    )


def first_text_label(cells: DataFrame, first_cols: int = 4) -> DataFrame:
    """Leftmost non-blank text of a row: (sheet, row_no, label)."""
    text = text_cells(cells.where(F.col("col_no") < first_cols))
    return text.groupBy("sheet", "row_no").agg(F.min_by("s", "col_no").alias("label"))


def lookup_header_join(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Number cells with the key of their column: (sheet, row_no, key, n).

    The map has one row per sheet and key.  It carries no broadcast hint, as it
    grows with the sheets: the join strategy follows its measured size, and a
    sheet that holds most cells is split by the adaptive skew join.
    """
    numbers = cells.where(F.col("n").isNotNull() & ~F.isnan("n"))
    return numbers.join(columns, ["sheet", "col_no"]).select("sheet", "row_no", "key", "n")


def _of_row(key: str) -> Column:
    """The row's value under ``key``; a row has at most one cell per key."""
    row = Window.partitionBy("sheet", "row_no")
    return F.max(F.when(F.col("key") == key, F.col("n"))).over(row)


def row_total_guard(keyed: DataFrame) -> DataFrame:
    """Drop the rows whose total cell is missing, not a number, or 0."""
    total = keyed.withColumn("total", _of_row(TOTAL))
    return total.where(F.col("total").isNotNull() & (F.col("total") != 0.0))


def row_measure_default(keyed: DataFrame, default: float = 0.0) -> DataFrame:
    """Copy the row's earmarked cell to all its cells, ``default`` without one."""
    return keyed.withColumn("earmarked", F.coalesce(_of_row(EARMARKED), F.lit(default)))


def _column_key(text: Column, entities: Sequence[str], total: str, earmark_like: str) -> Column:
    return (
        F.when(text.isin(*entities), text)
        .when(text == total, TOTAL)
        .when(F.lower(text).contains(earmark_like), EARMARKED)
    )


def row_facts(
    cells: DataFrame,
    entities: Sequence[str],
    rules: Rules,
    keys: Sequence[str] = ("BE", "DE", "Total"),
    total: str = "Total",
    earmark_like: str = "earmarked",
    marker_like: str = "nextgenerationeu",
    end_text: str = "REVENUE",
    label_cols: int = 4,
    end_cols: int = 3,
) -> DataFrame:
    """What the texts of each row say, one row per (sheet, row_no) with a text.

    is_header (every key is there), entries (col_no and key of its header cells), is_marker,
    is_end, mapped (leftmost label that maps, with its heading) and label (leftmost text).
    """
    text = text_cells(cells)
    s, at = F.col("s"), F.col("col_no")
    key = _column_key(s, entities, total, earmark_like)
    heading = map_heading("s", rules)
    found = [F.max((s == k).cast("int")) for k in keys]
    return text.groupBy("sheet", "row_no").agg(
        (F.least(*found) == 1 if len(found) > 1 else found[0] == 1).alias("is_header"),
        F.collect_list(F.when(key.isNotNull(), F.struct(at.alias("col_no"), key.alias("key")))).alias("entries"),
        F.max(F.lower(s).contains(marker_like)).alias("is_marker"),
        F.max((at < end_cols) & (F.upper(s) == end_text)).alias("is_end"),
        F.min_by(
            F.when((at < label_cols) & heading.isNotNull(), F.struct(s.alias("s"), heading.alias("heading"))),
            F.when((at < label_cols) & heading.isNotNull(), at),
        ).alias("mapped"),
        F.min_by(s, F.when(at < label_cols, at)).alias("first_text"),
        F.max(at < label_cols).alias("has_label"),
    ).select(
        "sheet", "row_no", "is_header", "entries", "is_marker", "is_end", "mapped",
        F.when(F.col("has_label"), F.col("first_text")).alias("label"),
    )


def _columns_of(entries: Column) -> Column:
    """map<col_no, key> of a header row; of several columns with one key the last stays."""
    last = F.filter(
        entries, lambda e: ~F.exists(entries, lambda f: (f["key"] == e["key"]) & (f["col_no"] > e["col_no"]))
    )
    return F.map_from_entries(F.array_distinct(F.transform(last, lambda e: F.struct(e["col_no"], e["key"]))))


def sheet_layout(facts: DataFrame, after: int = 40) -> DataFrame:
    """The layout of each sheet with a header, by one aggregate over ``row_facts``.

    header_row and columns (map<col_no, key>) of the first block; marker_row and end_row,
    where there are any; revenue_row and revenue_columns of the header at ``after`` or
    below, else those of the first block.
    """
    row, header = F.col("row_no"), F.col("is_header")
    late = header & (row >= after)
    found = facts.groupBy("sheet").agg(
        F.min(F.when(header, row)).alias("header_row"),
        F.min_by("entries", F.when(header, row)).alias("entries"),
        F.min(F.when(late, row)).alias("late_row"),
        F.min_by("entries", F.when(late, row)).alias("late_entries"),
        F.min(F.when(F.col("is_marker"), row)).alias("marker_row"),
        F.sort_array(F.collect_list(F.when(F.col("is_end"), row))).alias("ends"),
    )
    below = F.filter("ends", lambda e: e > F.col("header_row"))
    second = F.when(F.col("late_row").isNotNull(), F.col("late_entries")).otherwise(F.col("entries"))
    return found.where("header_row IS NOT NULL").select(
        "sheet",
        "header_row",
        _columns_of(F.col("entries")).alias("columns"),
        "marker_row",
        F.get(below, F.lit(0)).alias("end_row"),
        F.coalesce("late_row", "header_row").alias("revenue_row"),
        _columns_of(second).alias("revenue_columns"),
    )


def _keyed_numbers(cells: DataFrame, layout: DataFrame, columns: str) -> DataFrame:
    """(sheet, row_no, key, n) of the number cells whose column the sheet's map names."""
    numbers = cells.where(F.col("n").isNotNull() & ~F.isnan("n")).select("sheet", "row_no", "col_no", "n")
    met = numbers.join(layout.select("sheet", F.col(columns).alias("_columns")), "sheet")
    # a generator, so that the look-up is made once a cell and not again above each filter
    named = F.filter(F.array(F.try_element_at("_columns", F.col("col_no"))), lambda k: k.isNotNull())
    return met.select("sheet", "row_no", F.explode(named).alias("key"), "n")


def layout_of(
    cells: DataFrame, entities: Sequence[str], rules: Rules, keys: Sequence[str], after: int = 40
) -> tuple[DataFrame, DataFrame]:
    """(row facts, sheet layout), both stored: the one scan of the text cells."""
    facts = materialize(row_facts(cells, entities, rules, keys), "row-facts")
    return facts, materialize(sheet_layout(facts, after), "layout")


def unpivot_expenditure(
    cells: DataFrame,
    entities: Sequence[str],
    rules: Rules,
    preliminary_year: int = 2024,
    keys: Sequence[str] = ("BE", "DE", "Total"),
    parts: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per labelled row and entity with a number.

    ``parts`` are those of ``layout_of``, if they were made before.  Joining the row labels
    and copying the row's total and earmark share one shuffle on (sheet, row_no).
    """
    facts, layout = parts or layout_of(cells, entities, rules, keys)
    inside = (F.col("row_no") > F.col("header_row")) & (
        F.col("end_row").isNull() | (F.col("row_no") < F.col("end_row"))
    )
    flagged = F.when(F.col("row_no") >= F.col("marker_row"), 1).otherwise(0)
    rows = (
        facts.where(F.col("mapped").isNotNull())
        .join(layout.select("sheet", "header_row", "end_row", "marker_row"), "sheet")
        .where(inside)
        .select("sheet", "row_no", F.col("mapped.s").alias("heading_raw"), F.col("mapped.heading").alias("heading"), flagged.alias("is_ngeu"))
    )
    keyed = _keyed_numbers(cells, layout, "columns")
    guarded = row_total_guard(row_measure_default(keyed.join(rows, ["sheet", "row_no"])))
    year = F.expr("try_cast(sheet AS INT)")
    return guarded.where(~F.col("key").isin(TOTAL, EARMARKED)).select(
        "sheet",
        year.alias("year"),
        F.col("key").alias("country"),
        "heading_raw",
        "heading",
        round_mul("n", 4).alias("actual_meur"),
        round_mul("earmarked", 4).alias("earmarked_meur"),
        "is_ngeu",
        F.when(year == preliminary_year, 1).otherwise(0).alias("is_preliminary"),
        F.col("row_no").cast("long").alias("row_no"),
    )


def unpivot_revenue(
    cells: DataFrame,
    entities: Sequence[str],
    metric_rules: Rules,
    after: int = 40,
    keys: Sequence[str] = ("BE", "DE", "Total"),
    parts: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per metric row and entity with a number; ``parts`` as of ``layout_of``."""
    facts, layout = parts or layout_of(cells, entities, metric_rules, keys, after)
    rows = (
        facts.withColumn("metric", map_metric("label", metric_rules))
        .where(F.col("metric").isNotNull())
        .join(layout.select("sheet", "revenue_row"), "sheet")
        .where(F.col("row_no") > F.col("revenue_row"))
        .select("sheet", "row_no", "metric")
    )
    keyed = _keyed_numbers(cells, layout, "revenue_columns").join(rows, ["sheet", "row_no"])
    return keyed.where(~F.col("key").isin(TOTAL, EARMARKED)).select(
        "sheet",
        F.expr("try_cast(sheet AS INT)").alias("year"),
        F.col("key").alias("country"),
        "metric",
        round_mul("n", 4).alias("value_meur"),
        F.col("row_no").cast("long").alias("row_no"),
    )


def concat_sheets(expenditure: DataFrame, revenue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both long tables over all sheets; a sheet without expenditure gives nothing."""
    kept = revenue.join(expenditure.select("sheet").distinct(), "sheet", "left_semi")
    return expenditure.drop("sheet"), kept.drop("sheet")
