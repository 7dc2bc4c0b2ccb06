"""The registered queries: every operator on tables derived from the star schema."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions import exprs, labels
from panelspark.functions.crosswalk import (
    HEADING_RULES,
    METRIC_RULES,
    crosswalk_join,
    map_heading,
    map_metric,
)
from panelspark.operators import aggregates, audit, charts, forest, ingest, ranking, series, sketches
from panelspark.operators.audit import profile_scan
from panelspark.operators.intervals import interval_label
from panelspark.operators.matrix import feature_matrix
from panelspark.operators.neighbours import local_outlier_factor
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.quarantine import part_rows
from panelspark.operators.thresholds import contamination_threshold
from panelspark.plans import anomalies, documents
from panelspark.plans.features import build_features, heading_base
from panelspark.plans.ingest import parse_sheets
from panelspark.plans.run import ranked_table
from panelspark.schemas import EXPENDITURE, FEATURES, NET_POSITION, enforce_schema
from panelspark.session import materialize, new_name, new_path
from panelspark.sources import driver_tables as tables, sinks, tables as catalog_tables
from panelspark.sources.cells import read_cells, select_year_sheets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = tables.DIGITS
YEARS = list(range(1995, 2002))
COHORTS = [
    ("EU15", [f"NATION_{i}" for i in range(15)]),
    ("EU25", [f"NATION_{i}" for i in range(15, 22)]),
    ("EU27", ["NATION_22", "NATION_23"]),
    ("EU28", ["NATION_24"]),
]
PERIODS = [(1993, 1996, "1993-1996"), (1997, 1999, "1997-1999"), (2000, 2006, "2000-2006")]
EVENTS = [(1996, "First"), (1998, "Second"), (2000, "Third")]
DRIFT = [f"NATION_{i}" for i in (2, 5, 8, 13, 17, 21)]
CHRONIC = [f"NATION_{i}" for i in (1, 4, 9, 16)]
H1_KEYS = ["country", "year"]


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing _ keeps an import visible."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# Inputs ---------------------------------------------------------------------


def exp(spark: SparkSession, folder: str) -> DataFrame:
    return tables.expenditure(spark, folder)


def rev(spark: SparkSession, folder: str) -> DataFrame:
    return tables.revenue(spark, folder)


def headings(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.heading_level(exp(spark, folder), digits=DIGITS)


def feats(spark: SparkSession, folder: str) -> DataFrame:
    return build_features(exp(spark, folder), rev(spark, folder), digits=DIGITS)


def h1(spark: SparkSession, folder: str) -> DataFrame:
    return anomalies.net_positions(feats(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The H3 rows with the outlier factor and, as second method, the z-score flag."""
    rows = materialize(anomalies.absorption_set(feats(spark, folder)), "absorption")
    found = local_outlier_factor(rows, anomalies.MODEL_COLS)
    return found.withColumns(
        {
            "lof_score": exprs.round_mul("lof_score", 6),
            "z_anomaly": labels.zscore_flag("zscore_absorption"),
        }
    )


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(select_year_sheets(tables.cells(spark, folder)), "cells")


def header(cells: DataFrame) -> DataFrame:
    return ingest.locate_header(cells, tables.HEADER_KEYS)


def keyed(cells: DataFrame) -> DataFrame:
    columns = ingest.column_map(cells, header(cells), tables.NATIONS)
    return ingest.lookup_header_join(cells, columns)


def parsed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return parse_sheets(
        materialize(tables.cells(spark, folder), "grid"),
        entities=tables.NATIONS,
        heading_rules=tables.HEADING_RULES,
        keys=tables.HEADER_KEYS,
        preliminary_year=tables.PRELIMINARY_YEAR,
    )


# Sources, ingest, sinks -----------------------------------------------------


@query
def read_cells_(spark, folder):
    path = new_path(spark, "grid")
    sinks.write_table(tables.cells(spark, folder), path)
    return read_cells(spark, path).groupBy("sheet").agg(
        F.count("s").alias("n_text"), F.count("n").alias("n_number")
    )



@query
def select_year_sheets_(spark, folder):
    return aggregates.count_by(select_year_sheets(tables.cells(spark, folder)), "year")



@query
def locate_header(spark, folder):
    return header(sheets(spark, folder))


@query
def column_map(spark, folder):
    cells = sheets(spark, folder)
    return ingest.column_map(cells, header(cells), tables.NATIONS)


@query
def section_marker(spark, folder):
    return ingest.section_marker(sheets(spark, folder))


@query
def section_terminator(spark, folder):
    cells = sheets(spark, folder)
    return ingest.section_terminator(cells, header(cells))


@query
def first_mapped_label(spark, folder):
    return ingest.first_mapped_label(sheets(spark, folder), tables.HEADING_RULES)


@query
def row_total_guard(spark, folder):
    return ingest.row_total_guard(keyed(sheets(spark, folder))).select(
        "sheet", "row_no", "key", "n", "total"
    )


@query
def row_measure_default(spark, folder):
    return ingest.row_measure_default(keyed(sheets(spark, folder)))


@query
def sheet_layout(spark, folder):
    """The layout of every sheet, its map of columns as text."""
    facts = ingest.row_facts(sheets(spark, folder), tables.NATIONS, tables.HEADING_RULES, tables.HEADER_KEYS)
    found = ingest.sheet_layout(facts)

    def listed(columns: str):
        entries = F.transform(F.map_entries(columns), lambda e: F.struct(e["value"], e["key"]))
        parts = F.transform(F.sort_array(entries), lambda e: F.concat(e["value"], F.lit("="), e["key"].cast("string")))
        return F.array_join(parts, ",").alias(columns)

    return found.select("sheet", "header_row", listed("columns"), "marker_row", "end_row", "revenue_row", listed("revenue_columns"))


@query
def unpivot_expenditure(spark, folder):
    return ingest.unpivot_expenditure(
        sheets(spark, folder),
        tables.NATIONS,
        tables.HEADING_RULES,
        tables.PRELIMINARY_YEAR,
        tables.HEADER_KEYS,
    ).drop("sheet", "row_no")


@query
def first_text_label(spark, folder):
    return ingest.first_text_label(sheets(spark, folder))


@query
def unpivot_revenue(spark, folder):
    return ingest.unpivot_revenue(
        sheets(spark, folder),
        tables.NATIONS,
        METRIC_RULES,
        keys=tables.HEADER_KEYS,
    ).drop("sheet")


@query
def concat_sheets(spark, folder):
    spending, income = parsed(spark, folder)
    spent = spending.select(F.lit("expenditure").alias("kind"), "year", "country")
    earned = income.select(F.lit("revenue").alias("kind"), "year", "country")
    return aggregates.count_by(spent.unionByName(earned), "kind", "year")


@query
def parsed_heading_level(spark, folder):
    spending, _ = parsed(spark, folder)
    return aggregates.heading_level(spending, digits=DIGITS)


@query
def parsed_revenue_wide(spark, folder):
    _, income = parsed(spark, folder)
    return aggregates.pivot_revenue(income)


@query
def enforce_schema_(spark, folder):
    return enforce_schema(exp(spark, folder), EXPENDITURE)



@query
def cache_table(spark, folder):
    """Two aggregates of one cached table, stored before its blocks are released."""
    with sinks.cached(exp(spark, folder).select("is_ngeu", "year", "actual_meur")) as kept:
        sums = [F.count("*").alias("n"), exprs.exact_sum("actual_meur", DIGITS).alias("total")]
        found = [
            kept.groupBy(F.lit(by).alias("by"), F.col(by).cast("int").alias("value")).agg(*sums)
            for by in ("is_ngeu", "year")
        ]
        return materialize(found[0].unionByName(found[1]), "cached")


@query
def register_view(spark, folder):
    name = new_name("exp_raw")
    sinks.register_view(exp(spark, folder), name)
    return spark.sql(
        f"SELECT country, min(year) AS first_year, count(*) AS n FROM {name} GROUP BY country"
    )


@query
def create_or_replace_table_as(spark, folder):
    return sinks.create_or_replace_table_as(
        exp(spark, folder),
        new_name("receipts"),
        "SELECT year, country, "
        "CAST(sum(CAST(actual_meur AS DECIMAL(18, 4))) AS DOUBLE) AS receipts_meur "
        "FROM {df} WHERE is_ngeu = 0 GROUP BY year, country",
    )


@query
def replace_table_as(spark, folder):
    """A table of the catalog, made twice; the second time from its own old rows."""
    name = new_name("receipts")
    catalog_tables.replace_table_as(
        exp(spark, folder).where("is_ngeu = 0"),
        name,
        "SELECT year, country, CAST(actual_meur AS DECIMAL(18, 4)) AS amount FROM {df}",
    )
    return catalog_tables.replace_table_as(
        spark.newSession().table(name),
        name,
        "SELECT year, country, CAST(sum(amount) AS DOUBLE) AS receipts_meur FROM {df} GROUP BY year, country",
    )


@query
def write_bucketed_features(spark, folder):
    """Lags and z-scores from the bucketed table, whose windows need no exchange."""
    columns = [*SERIES, "year", "actual_meur", "absorption_gap_meur"]
    stored = catalog_tables.write_bucketed(
        feats(spark, folder).select(*columns), new_name("features"), SERIES, ["year"], 8
    )
    found = series.lags(stored, "actual_meur", SERIES, "year")
    z = series.zscore_over("absorption_gap_meur", SERIES)
    return found.select(*ranking.KEYS, "lag1", "lag2", "lag3", z.alias("zscore_absorption"))


@query
def write_features(spark, folder):
    path = new_path(spark, "features")
    sinks.write_sorted(feats(spark, folder), path, ["country", "heading", "year"])
    return spark.read.schema(FEATURES).parquet(path)


@query
def write_scores(spark, folder):
    path = new_path(spark, "scores")
    sinks.write_table(scored(spark, folder), path)
    return spark.read.parquet(path).select(
        *ranking.KEYS, "lof_score", "lof_anomaly", "z_anomaly"
    )


@query
def write_h1(spark, folder):
    path = new_path(spark, "h1")
    sinks.write_table(h1(spark, folder), path, "csv")
    return spark.read.schema(NET_POSITION).option("header", True).csv(path)


@query
def write_ranked(spark, folder):
    path = new_path(spark, "ranked")
    best = ranked_anomalies(spark, folder)
    sinks.write_table(best, path, "csv")
    return spark.read.schema(best.schema).option("header", True).csv(path)


@query
def write_audit(spark, folder):
    path = new_path(spark, "audit")
    document = nested_audit(spark, folder)
    sinks.write_document(document, path)
    return flat_audit(spark.read.schema(document.schema).json(path))


@query
def write_summary(spark, folder):
    path = new_path(spark, "summary")
    document = run_summary(spark, folder)
    sinks.write_document(document, path)
    return spark.read.schema(document.schema).json(path)


# Projections, filters, predicates -------------------------------------------


@query
def project_columns(spark, folder):
    return ranking.project_columns(feats(spark, folder), anomalies.H3_COLS)


@query
def select_star_plus(spark, folder):
    return headings(spark, folder).selectExpr(
        "*", "CAST(actual_meur - earmarked_meur AS DOUBLE) AS over_meur", "year - 2000 AS idx"
    )


@query
def cte_base(spark, folder):
    return feats(spark, folder).drop("zscore_absorption", "zscore_net")


@query
def exclude_flagged(spark, folder):
    return aggregates.exclude_flagged(exp(spark, folder)).select(
        "year", "country", "heading", "row_no"
    )


@query
def h3_working_set(spark, folder):
    return anomalies.h3_working_set(feats(spark, folder)).select(*ranking.KEYS, "lag1")


@query
def range_outliers(spark, folder):
    rows = materialize(exp(spark, folder).select("row_no", "actual_meur"), "amounts")
    bounds = audit.fences(audit.amount_stats(rows, "actual_meur", digits=DIGITS), 0.5)
    fence = bounds.select(F.struct("lower_bound", "upper_bound")).scalar()
    found = audit.range_outliers(rows, "actual_meur", fence["lower_bound"], fence["upper_bound"])
    return found.select("row_no", F.col("actual_meur").cast("double").alias("actual_meur"))


@query
def negative_rows(spark, folder):
    return audit.negative_rows(feats(spark, folder), "yoy_change").select(
        *ranking.KEYS, "yoy_change"
    )


@query
def entity_subset(spark, folder):
    return ranking.entity_subset(headings(spark, folder), DRIFT)


@query
def latest_period(spark, folder):
    return ranking.latest_period(materialize(headings(spark, folder), "headings"))


@query
def flag_split(spark, folder):
    flagged, normal = ranking.flag_split(scored(spark, folder), "lof_anomaly")
    halves = [
        half.select(*ranking.KEYS, F.lit(side).alias("side"))
        for half, side in ((flagged, "anomaly"), (normal, "normal"))
    ]
    return halves[0].unionByName(halves[1])


@query
def fill_constant(spark, folder):
    """The first rows of a series have no earlier values, which are filled."""
    rows = series.lags(headings(spark, folder), "actual_meur", SERIES, "year")
    found = ranking.fill_constant(rows, {"lag1": 0.0, "lag2": -1.0})
    return found.select(*ranking.KEYS, "lag1", "lag2", "lag3")


@query
def constraint_checks(spark, folder):
    rules = audit.standard_rules(DRIFT, 1996, 2001)
    return audit.constraint_checks(feats(spark, folder), rules)


@query
def quarantine_rows(spark, folder):
    """The rows that break a rule, with the rules they break."""
    rules = audit.standard_rules(DRIFT, 1996, 2001)
    _, bad, _ = part_rows(feats(spark, folder), rules, new_path(spark, "parted"))
    return bad.select(*ranking.KEYS, F.array_join("broken", ",").alias("broken"))


@query
def quarantine_counts(spark, folder):
    """Rows kept, rows set aside, and the breaches of each rule, from one pass."""
    rules = audit.standard_rules(DRIFT, 1996, 2001)
    clean, bad, counts = part_rows(feats(spark, folder), rules, new_path(spark, "parted"))
    sizes = [
        part.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        for name, part in (("kept", clean), ("set aside", bad))
    ]
    return counts.unionByName(sizes[0]).unionByName(sizes[1])


@query
def min_records_check(spark, folder):
    return aggregates.min_records_check(rev(spark, folder), "year", 2000)


# Joins -----------------------------------------------------------------------


@query
def join_revenue(spark, folder):
    wide = aggregates.pivot_revenue(rev(spark, folder))
    return aggregates.join_revenue(headings(spark, folder), wide)


@query
def join_receipts(spark, folder):
    """Both grains from one scan and one shuffle of the raw rows."""
    base = materialize(heading_base(exp(spark, folder), DIGITS), "headings")
    receipts = base.groupBy("year", "country").agg(
        F.sum("_receipts").cast("double").alias("receipts_meur")
    )
    return aggregates.join_receipts(base.drop("_receipts"), receipts)


@query
def lookup_header_join(spark, folder):
    return keyed(sheets(spark, folder))


@query
def crosswalk_join_(spark, folder):
    schema = "ordinal int, key string, value string"
    rows = [(i, key, value) for i, (key, value) in enumerate(HEADING_RULES)]
    rules = spark.createDataFrame(rows, schema)
    return crosswalk_join(tables.labels(spark, folder), "label", rules)



# Aggregations ----------------------------------------------------------------


@query
def heading_level(spark, folder):
    return headings(spark, folder)


@query
def total_receipts(spark, folder):
    return aggregates.total_receipts(exp(spark, folder), digits=DIGITS)


@query
def pivot_revenue(spark, folder):
    return aggregates.pivot_revenue(rev(spark, folder))


@query
def null_profile(spark, folder):
    return audit.null_profile(feats(spark, folder))


@query
def duplicate_profile(spark, folder):
    rows = exp(spark, folder).select("year", "country", "heading", "is_ngeu", "earmarked_meur")
    return audit.duplicate_profile(rows)


def amounts(spark, folder) -> DataFrame:
    return materialize(exp(spark, folder).select("actual_meur"), "amounts")


@query
def amount_stats(spark, folder):
    found = audit.amount_stats(amounts(spark, folder), "actual_meur", digits=DIGITS)
    return found.withColumn("stddev", exprs.round_mul("stddev", 4))


@query
def fine_sums(spark, folder):
    """Charged prices have six decimals: sums and means finer than the panel's amounts."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = tables.table(spark, folder, "lineitem").select(
        "l_returnflag", exprs.round_amount(charge, 6).alias("charge"), (charge / 1e9).alias("share")
    )
    return lines.groupBy("l_returnflag").agg(
        exprs.exact_sum("charge", 6).alias("total"),
        exprs.mean_of_rows("charge", 6).alias("mean"),
        exprs.round_mul(exprs.total_of("share"), 6).alias("share_total"),
    )


@query
def discrete_quantiles(spark, folder):
    rows = materialize(rev(spark, folder).select("value_meur"), "amounts")
    return exact_quantiles(rows, "value_meur", [0.01, 0.05, 0.5, 0.99])


@query
def exact_quantiles_(spark, folder):
    rows = materialize(rev(spark, folder).select("value_meur"), "amounts")
    found = exact_quantiles(rows, "value_meur", [0.01, 0.05, 0.5, 0.99], True)
    return found.select("q", exprs.round_mul("value", 6).alias("value"))



@query
def sketched_quartiles(spark, folder):
    """Whether quantiles from the merged sketches of all years lie within the stated rank error."""
    rows = materialize(exp(spark, folder).select("year", F.col("actual_meur").cast("double")), "amounts")
    found = sketches.merged_quantiles(sketches.period_sketches(rows, "actual_meur"), [0.05, 0.25, 0.5, 0.75, 0.95])
    found = materialize(found, "quantiles")
    met = rows.join(F.broadcast(found), F.col("actual_meur") <= F.col("value"))  # five rows
    share = F.count("*") / rows.agg(F.count("*")).scalar()
    ranks = met.groupBy("q").agg(share.alias("share"))
    return ranks.select("q", (F.abs(F.col("share") - F.col("q")) <= 2 * sketches.rank_error()).alias("within"))


@query
def iqr_outliers(spark, folder):
    found = audit.iqr_outliers(amounts(spark, folder), "actual_meur", 0.5, digits=DIGITS)
    return found.withColumns(
        {
            "stddev": exprs.round_mul("stddev", 4),
            "outlier_pct": exprs.round_mul("outlier_pct", 4),
        }
    )


@query
def country_coverage(spark, folder):
    return aggregates.country_coverage(exp(spark, folder), periods=7)


@query
def coverage_summary(spark, folder):
    return aggregates.coverage_summary(aggregates.country_coverage(exp(spark, folder), periods=7))


@query
def heading_distribution(spark, folder):
    return aggregates.heading_distribution(exp(spark, folder), digits=DIGITS)


@query
def temporal_distribution(spark, folder):
    return aggregates.count_by(exp(spark, folder), "year")


def quality(spark, folder) -> DataFrame:
    return documents.audit_profiles(tables.expenditure_with_gaps(spark, folder), digits=DIGITS)[3]


@query
def quality_score(spark, folder):
    return quality(spark, folder)


def nested_audit(spark, folder) -> DataFrame:
    raw = tables.expenditure_with_gaps(spark, folder)
    return documents.audit_document(raw, stamp=F.lit("fixed"), period="1995-2001", digits=DIGITS)


def flat_audit(found: DataFrame) -> DataFrame:
    missing = F.col("missing_values")
    outliers, copies, scores = (F.col(c) for c in ("outliers", "duplicates", "quality_scores"))
    return found.select(
        "timestamp",
        "pipeline_version",
        "data_period",
        missing["actual_meur"]["count"].alias("missing_actual"),
        missing["heading"]["status"].alias("missing_heading_status"),
        missing["earmarked_meur"]["pct"].alias("missing_earmarked_pct"),
        missing["earmarked_meur"]["status"].alias("missing_earmarked_status"),
        copies["total"].alias("total"),
        copies["duplicate_count"].alias("duplicate_count"),
        outliers["mean"].alias("mean"),
        outliers["median"].alias("median"),
        outliers["std"].alias("std"),
        outliers["iqr"].alias("iqr"),
        outliers["outlier_count"].alias("outlier_count"),
        scores["overall"].alias("overall"),
        scores["status"].alias("status"),
    )


@query
def audit_scan(spark, folder):
    """What is observed in the one scan of the audit, null counts as columns."""
    raw = tables.expenditure_with_gaps(spark, folder)
    found = profile_scan(raw, "actual_meur", digits=DIGITS)
    nulls = {f"nulls{i}": f"no_{c}" for i, c in enumerate(found.columns)}
    return found.metrics.withColumnsRenamed(nulls).withColumn("stddev", exprs.round_mul("stddev", 4))


@query
def audit_document(spark, folder):
    return flat_audit(nested_audit(spark, folder))


@query
def h1_collapse(spark, folder):
    return anomalies.h1_collapse(feats(spark, folder))


@query
def h1_summary(spark, folder):
    return anomalies.h1_summary(h1(spark, folder))


@query
def method_comparison(spark, folder):
    return ranking.method_comparison(scored(spark, folder), "z_anomaly", "lof_anomaly")


@query
def run_summary(spark, folder):
    features = materialize(feats(spark, folder), "features")
    rows = materialize(anomalies.absorption_set(features), "absorption")
    found = local_outlier_factor(rows, anomalies.MODEL_COLS)
    found = found.withColumn("z_anomaly", labels.zscore_flag("zscore_absorption"))
    return documents.run_summary(
        features,
        anomalies.net_positions(features),
        found,
        quality(spark, folder),
        stamp=F.lit("fixed"),
        a="z_anomaly",
        b="lof_anomaly",
    )


@query
def rows_by_year(spark, folder):
    return charts.rows_by_year(feats(spark, folder), PERIODS)


@query
def rows_by_entity_year(spark, folder):
    return charts.rows_by_entity_year(exp(spark, folder), YEARS)


@query
def value_counts(spark, folder):
    return aggregates.count_by(exp(spark, folder), "heading")


@query
def total_by_year_bn(spark, folder):
    return aggregates.total_by_year_bn(exp(spark, folder), digits=DIGITS)


@query
def anomaly_grid(spark, folder):
    return charts.anomaly_grid(scored(spark, folder), "lof_anomaly", YEARS)


@query
def mean_rate_by_heading(spark, folder):
    return charts.mean_rate_by_heading(anomalies.absorption_set(feats(spark, folder)), digits=2)


@query
def anomalies_by_year(spark, folder):
    return aggregates.sum_flag_by(scored(spark, folder), "lof_anomaly", "year")


@query
def unique_headings(spark, folder):
    return aggregates.unique_values(exp(spark, folder), "heading").orderBy("heading")


# Windows ---------------------------------------------------------------------

SERIES = ["country", "heading"]


@query
def yoy_change(spark, folder):
    found = series.yoy_change(headings(spark, folder), "actual_meur", SERIES, "year")
    return found.select(*ranking.KEYS, "yoy_change")


@query
def lags_1_2_3(spark, folder):
    found = series.lags(headings(spark, folder), "actual_meur", SERIES, "year")
    return found.select(*ranking.KEYS, "lag1", "lag2", "lag3")


@query
def rolling_mean_prev3(spark, folder):
    found = series.rolling_mean_prev(
        headings(spark, folder), "actual_meur", SERIES, "year", decimals=DIGITS
    )
    return found.select(*ranking.KEYS, "roll_mean_3")


def lagged_lines(spark, folder, chunk: int) -> DataFrame:
    lines = exp(spark, folder).groupBy("country", "row_no")
    lines = materialize(lines.agg(exprs.exact_sum("actual_meur", DIGITS).alias("actual_meur")), "lines")
    found = series.lags(lines, "actual_meur", ["country"], "row_no", chunk=chunk)
    return found.select("country", "row_no", "lag1", "lag2", "lag3")


@query
def lags_by_range(spark, folder):
    """Lags along the line items of a nation, its series cut into ranges of rows."""
    return lagged_lines(spark, folder, 20_000)


@query
def lags_by_short_range(spark, folder):
    """The same over ranges of a few rows, which pass their tails up and down a tree."""
    return lagged_lines(spark, folder, 250)


@query
def zscore_absorption(spark, folder):
    gap = exprs.absorption_gap("earmarked_meur", "actual_meur")
    rows = headings(spark, folder).withColumn("absorption_gap_meur", gap)
    z = series.zscore_over("absorption_gap_meur", SERIES)
    return rows.select(*ranking.KEYS, z.alias("zscore_absorption"))


@query
def zscore_net(spark, folder):
    return feats(spark, folder).select(*ranking.KEYS, "zscore_net")


@query
def zscore_lines(spark, folder):
    """z-score of every line item within its heading, a group of unbounded size."""
    raw = exp(spark, folder).select("row_no", "heading", F.col("actual_meur").cast("double"))
    found = series.zscore(materialize(raw, "lines"), "actual_meur", ["heading"], "z", 3)
    return found.select("row_no", "z")


@query
def h1_drift(spark, folder):
    return h1(spark, folder).select(*H1_KEYS, "net_position_lag1", "net_position_change")


# Sorts, limits, top-k, sets ----------------------------------------------------


@query
def sort_features(spark, folder):
    return ranking.sort_by(feats(spark, folder), "country", "heading", "year")


@query
def ranked_anomalies(spark, folder):
    best = ranking.ranked_anomalies(scored(spark, folder), "lof_anomaly", "lof_score")
    return best.select(
        "year", "country", "heading", "absorption_gap_meur", "absorption_rate_pct", "lof_score"
    )


@query
def top_k_scores(spark, folder):
    return charts.top_anomalies(scored(spark, folder), "lof_score", 10)


@query
def most_normal_scores(spark, folder):
    return charts.top_anomalies(scored(spark, folder), "lof_score", 10, ascending=False)


@query
def sort_net_position(spark, folder):
    rows = charts.net_position_ranking(materialize(h1(spark, folder), "h1"))
    return ranking.sort_by(rows, F.col("net_position_bn").asc_nulls_last(), "country")


@query
def distinct_rows(spark, folder):
    """Whole rows, of a table that has each row of the flagged section twice."""
    raw = exp(spark, folder).withColumns(
        {c: F.col(c).cast("double") for c in ("actual_meur", "earmarked_meur")}
    )
    return aggregates.distinct_rows(raw.unionByName(raw.where("is_ngeu = 1")))


# Scalar functions ----------------------------------------------------------------


def with_entities(spark, folder) -> DataFrame:
    raw = exp(spark, folder)
    wide = aggregates.pivot_revenue(rev(spark, folder))
    return aggregates.join_revenue(aggregates.total_receipts(raw, digits=DIGITS), wide)


@query
def net_position(spark, folder):
    net = exprs.net_position("receipts_meur", "total_contributions")
    return with_entities(spark, folder).select(*H1_KEYS, net.alias("net_position_meur"))


@query
def net_pct_gni(spark, folder):
    pct = exprs.net_pct_gni("receipts_meur", "total_contributions", "gni_size")
    return with_entities(spark, folder).select(*H1_KEYS, pct.alias("net_pct_gni"))


@query
def absorption_gap(spark, folder):
    gap = exprs.absorption_gap("earmarked_meur", "actual_meur")
    return headings(spark, folder).select(*ranking.KEYS, gap.alias("absorption_gap_meur"))


@query
def absorption_rate(spark, folder):
    rate = exprs.absorption_rate("actual_meur", "earmarked_meur")
    return headings(spark, folder).select(*ranking.KEYS, rate.alias("absorption_rate_pct"))


@query
def year_index(spark, folder):
    return exp(spark, folder).select("row_no", exprs.year_index("year").alias("year_index"))


@query
def zscore_flag(spark, folder):
    flag = labels.zscore_flag("zscore_absorption", 1.5)
    return feats(spark, folder).select(*ranking.KEYS, flag.alias("flag"))


@query
def severity_band(spark, folder):
    band = labels.severity_band("zscore_absorption", 1.0, 1.5).alias("z_band")
    rate = labels.absorption_band("absorption_rate_pct", 95.0).alias("rate_band")
    return feats(spark, folder).select(*ranking.KEYS, band, rate)


def band_table(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "start double, end double, label string, ordinal int")


@query
def mff_period_table(spark, folder):
    """The periods from a table instead of a fixed chain."""
    periods = band_table(spark, [(float(a), float(b), name) for a, b, name in PERIODS])
    found = interval_label(exp(spark, folder).select("year"), "year", periods, "period")
    return aggregates.count_by(found, "period")


@query
def severity_band_table(spark, folder):
    """Bands with open ends, the end left to the next one, over the size of the z-score."""
    bands = band_table(spark, [(None, 1.0, "normal"), (1.0, 1.5, "anomaly"), (1.5, None, "extreme")])
    rows = feats(spark, folder).withColumn("size", F.abs("zscore_absorption"))
    found = interval_label(rows, "size", bands, "z_band", closed="left")
    return found.select(*ranking.KEYS, "z_band")


@query
def price_bands(spark, folder):
    """Ten thousand bands of a price, some of them overlapped by a wide one of lower rank."""
    steps = spark.range(10_000).select(
        (F.col("id") * 50.0).alias("start"),
        (F.col("id") * 50.0 + 50.0).alias("end"),
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("label"),
        (F.col("id") + 1).alias("ordinal"),
    )
    wide = spark.range(1).select(
        F.lit(100_000.0).alias("start"), F.lit(120_000.0).alias("end"), F.lit("wide").alias("label"), F.col("id").alias("ordinal")
    )
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    found = interval_label(orders, "o_totalprice", steps.unionByName(wide), "band", closed="left")
    return found.select("o_orderkey", "band")


@query
def mff_period(spark, folder):
    period = labels.mff_period("year", PERIODS).alias("period")
    return aggregates.count_by(exp(spark, folder).select(period), "period")


@query
def policy_event(spark, folder):
    event = labels.policy_event("year", EVENTS).alias("event")
    return aggregates.count_by(exp(spark, folder).select(event), "event")


@query
def accession_cohort(spark, folder):
    cohort = labels.accession_cohort("country", COHORTS).alias("cohort")
    return aggregates.count_by(exp(spark, folder).select(cohort), "cohort")


@query
def net_status(spark, folder):
    net = exprs.net_position("receipts_meur", F.col("gni_size") * 10.0)
    return with_entities(spark, folder).select(*H1_KEYS, labels.net_status(net).alias("status"))


@query
def map_heading_(spark, folder):
    rows = tables.labels(spark, folder)
    return rows.select("p_partkey", map_heading("label").alias("heading"))



@query
def map_metric_(spark, folder):
    rows = tables.metric_labels(spark, folder)
    return rows.select("o_orderkey", map_metric("label").alias("metric"))



@query
def anomaly_label(spark, folder):
    text = labels.anomaly_label("country", "year", "heading_raw")
    return exp(spark, folder).select("row_no", text.alias("label"))


@query
def scale_to_bn(spark, folder):
    return headings(spark, folder).select(
        *ranking.KEYS, exprs.scale_to_bn("actual_meur").alias("actual_bn")
    )


@query
def percent_of(spark, folder):
    return headings(spark, folder).select(
        *ranking.KEYS, exprs.percent_of("actual_meur", "earmarked_meur").alias("pct")
    )


@query
def to_json_document(spark, folder):
    document = exprs.to_json_document("year", "country", "heading", "is_ngeu", "is_preliminary")
    return exp(spark, folder).select("row_no", document.alias("document"))


@query
def format_now(spark, folder):
    """The stamp of a given time; the clock is only the default."""
    orders = tables.table(spark, folder, "orders")
    stamp = exprs.format_now(at=F.col("o_orderdate").cast("timestamp"))
    return orders.groupBy(stamp.alias("stamp")).agg(F.count("*").alias("n"))


@query
def elementary(spark, folder):
    text, number = F.col("heading_raw"), F.col("actual_meur").cast("double")
    return exp(spark, folder).select(
        "row_no",
        F.lower(text).alias("lower_text"),
        F.upper(F.concat(F.lit("  x"), text, F.lit(" "))).alias("upper_text"),
        ingest.strip(F.concat(F.lit(" \t"), text, F.lit(" "))).alias("stripped"),
        text.contains("MO").alias("has_mo"),
        F.expr("try_cast(substring(country, 8, 2) AS INT)").alias("parsed"),
        F.expr("try_cast(heading_raw AS INT)").alias("not_parsed"),
        F.abs(-number).alias("size"),
        exprs.round_mul(number, 1).alias("rounded"),
        F.nullif(F.col("is_ngeu"), F.lit(0)).alias("nullif_zero"),
    )


# Anomaly detection ---------------------------------------------------------------


@query
def feature_matrix_(spark, folder):
    rows = anomalies.h3_working_set(feats(spark, folder))
    return feature_matrix(rows, anomalies.MODEL_COLS, ranking.KEYS)



@query
def isolation_forest(spark, folder):
    rows = materialize(anomalies.absorption_set(feats(spark, folder)), "absorption")
    found = forest.isolation_forest(rows, anomalies.MODEL_COLS, list(ranking.KEYS))
    return found.select(*ranking.KEYS, exprs.round_mul("if_score", 6).alias("if_score"), "if_anomaly")


def both_models(spark, folder) -> DataFrame:
    """The H3 rows with both scores, rounded for comparison."""
    found = anomalies.absorption_anomalies(feats(spark, folder))
    return found.withColumns({c: exprs.round_mul(c, 6) for c in ("if_score", "lof_score")})


@query
def forest_ranked(spark, folder):
    """The published ranking: by the forest, the outlier factor beside it."""
    return ranked_table(both_models(spark, folder))


@query
def forest_top_k(spark, folder):
    return charts.top_anomalies(both_models(spark, folder), "if_score", 10)


@query
def forest_grid(spark, folder):
    return charts.anomaly_grid(both_models(spark, folder), "if_anomaly", YEARS)


@query
def forest_by_year(spark, folder):
    return aggregates.sum_flag_by(both_models(spark, folder), "if_anomaly", "year")


@query
def forest_comparison(spark, folder):
    return ranking.method_comparison(both_models(spark, folder), "if_anomaly", "lof_anomaly")


@query
def forest_summary(spark, folder):
    """The run summary as published: the forest against the outlier factor."""
    features = materialize(feats(spark, folder), "features")
    return documents.run_summary(
        features,
        anomalies.net_positions(features),
        materialize(anomalies.absorption_anomalies(features), "scores"),
        quality(spark, folder),
        stamp=F.lit("fixed"),
    )


@query
def local_outlier_factor_(spark, folder):
    return scored(spark, folder).select(*ranking.KEYS, "lof_score", "lof_anomaly")


CUSTOMER_COLS = ["c_acctbal", "n_orders", "largest", "smallest"]


def customer_points(spark, folder) -> DataFrame:
    return materialize(tables.customer_orders(spark, folder), "customers")


@query
def lof_over_leaves(spark, folder):
    """Outlier factor of every customer, over many small leaves."""
    found = local_outlier_factor(customer_points(spark, folder), CUSTOMER_COLS, k=10, leaf_rows=24)
    return found.select("c_custkey", exprs.round_mul("lof_score", 6).alias("lof_score"), "lof_anomaly")


@query
def lof_by_projections(spark, folder):
    """The approximate form; its neighbours are held against the exact ones in a test."""
    found = local_outlier_factor(customer_points(spark, folder), CUSTOMER_COLS, k=10, method="lsh")
    return found.select("c_custkey", "lof_score", "lof_anomaly")


@query
def contamination_threshold_(spark, folder):
    rows = materialize(exp(spark, folder).select("actual_meur"), "amounts")
    found = contamination_threshold(rows, "actual_meur", 0.05)
    return found.select(exprs.round_mul("threshold", 6).alias("threshold"))



@query
def zscore_baseline(spark, folder):
    flagged, _ = ranking.flag_split(h1(spark, folder), "h1_anomaly")
    return flagged.select(*H1_KEYS, "zscore_net", "h1_anomaly")


@query
def absorption_anomalies(spark, folder):
    return both_models(spark, folder)


@query
def features(spark, folder):
    return feats(spark, folder)


@query
def features_by_range(spark, folder):
    """The same table with the series cut into ranges of two years."""
    return build_features(exp(spark, folder), rev(spark, folder), chunk=2, digits=DIGITS)


# Chart tables ----------------------------------------------------------------------


@query
def net_drift_series(spark, folder):
    return charts.net_drift_series(h1(spark, folder), DRIFT)


@query
def policy_timeline(spark, folder):
    return charts.policy_timeline(scored(spark, folder), "lof_anomaly", EVENTS)


@query
def chronic_points(spark, folder):
    return charts.chronic_points(scored(spark, folder), "lof_anomaly", CHRONIC)
