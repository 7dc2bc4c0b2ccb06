"""One SELECT per registered query, to follow the common table expressions."""

from panelspark_check.base import RAW_COLUMNS

# Which heading each text of the label table stands for, in its order, as read from the definitions.
_LABELS = [
    "1. Agriculture and rural development", "Preservation and management of resources", "NATURAL RESOURCES and environment",
    "2. Structural actions", "1. Sustainable growth", "1.1 Smart and inclusive growth", "2. Cohesion, resilience and values",
    "3. Internal policies", "1. Single Market, Innovation and Digital",
    "4. External actions", "4. EU as a global player", "Global Europe", "6. Neighbourhood and the world",
    "7. European public administration",
    "3. Citizenship, freedom, security and justice", "3. Security and citizenship", "4. Migration and border management", "5. Security and defence",
    "7. Pre-accession strategy", "of which NextGenerationEU",
    "Sustainable growth: natural resources", "Administration and security and defence", "Other items",
]
_HEADINGS = (
    ["Agriculture & Rural Dev"] * 3
    + ["Structural & Cohesion"] * 4
    + ["Internal / Single Market"] * 2
    + ["External & Global"] * 4
    + ["Administration"]
    + ["Security & Citizenship"] * 4
    + ["Pre-Accession", "NGEU Recovery", "Agriculture & Rural Dev", "Administration", None]
)
_METRICS = (
    ["total_contributions"] * 2
    + ["gni_contribution"] * 3
    + ["vat_contribution"] * 2
    + ["customs"] * 2
    + ["gni_size", "total_expenditure", "gni_contribution", None]
)


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_DRIFT = "('NATION_2', 'NATION_5', 'NATION_8', 'NATION_13', 'NATION_17', 'NATION_21')"
_CHRONIC = "('NATION_1', 'NATION_4', 'NATION_9', 'NATION_16')"
_YEARS = range(1995, 2002)
_RANKED = """
SELECT year, country, heading, absorption_gap_meur, absorption_rate_pct, lof_score
FROM scored WHERE lof_anomaly = 1 ORDER BY lof_score, country, heading, year LIMIT 30
"""
_H1 = """
SELECT country, year, net_position_meur, net_pct_gni, zscore_net, receipts_meur,
  total_contributions, h1_anomaly, net_position_lag1, net_position_change FROM h1
"""
_AUDIT = """
SELECT 'fixed' AS timestamp, '1.0' AS pipeline_version, '1995-2001' AS data_period,
  (SELECT null_count FROM gap_shares WHERE column_name = 'actual_meur') AS missing_actual,
  (SELECT status FROM gap_shares WHERE column_name = 'heading') AS missing_heading_status,
  (SELECT round(pct, 2) FROM gap_shares WHERE column_name = 'earmarked_meur') AS missing_earmarked_pct,
  (SELECT status FROM gap_shares WHERE column_name = 'earmarked_meur') AS missing_earmarked_status,
  CAST(total AS BIGINT) AS total, CAST(total - "distinct" AS BIGINT) AS duplicate_count,
  round(mean, 2) AS mean, round(median, 2) AS median, round(stddev, 2) AS std,
  round(iqr, 2) AS iqr, outlier_count, overall, status
FROM gap_fence, gap_copies, quality_row
"""
_SCAN = f"""
SELECT count(*) AS rows, {', '.join(f'count(*) - count({c}) AS no_{c}' for c in RAW_COLUMNS)},
  any_value(mean) AS mean, round(any_value(stddev), 4) AS stddev, any_value("min") AS "min", any_value("max") AS "max",
  count(*) FILTER (actual_meur < 0) AS negative, CAST(max(year) AS BIGINT) AS max_period
FROM gappy, gap_amounts
"""
_COMPARED = """
  count(*) AS n_total, count(*) FILTER (WHERE z_anomaly = 1) AS n_a,
  count(*) FILTER (WHERE lof_anomaly = 1) AS n_b,
  count(*) FILTER (WHERE z_anomaly = 1 AND lof_anomaly = 1) AS n_both
"""
_SUMMARY = f"""
SELECT 'fixed' AS timestamp, (SELECT count(*) FROM features) AS feature_rows,
  (SELECT count(*) FROM h1) AS h1_country_years,
  (SELECT CAST(sum(h1_anomaly) AS BIGINT) FROM h1) AS h1_anomalies,
  n_total AS h3_rows_scored, n_a AS h3_if_anomalies, n_b AS h3_lof_anomalies,
  n_both AS h3_both_agree,
  round(100.0 * n_both / CAST(greatest(n_a, 1) AS DOUBLE), 1) AS agreement_rate_pct,
  coalesce(round(100.0 * n_both / CAST(nullif(n_a, 0) AS DOUBLE), 1), 0.0) AS precision_if_vs_lof,
  'Local Outlier Factor (LOF)' AS baseline_method,
  (SELECT overall FROM quality_row) AS overall_quality_score
FROM (SELECT {_COMPARED} FROM scored) q
"""
_FEATURE_COLUMNS = (
    "year country heading actual_meur earmarked_meur is_ngeu is_preliminary receipts_meur "
    "total_contributions gni_size net_pct_gni net_position_meur absorption_gap_meur "
    "absorption_rate_pct yoy_change lag1 lag2 lag3 roll_mean_3 year_index zscore_absorption "
    "zscore_net"
).split()
_NULLS = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,
  round(100.0 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE), 2) AS null_pct,
  CASE WHEN 100.0 * (count(*) - count({c})) / count(*) < 20 THEN 'OK' ELSE 'WARNING' END AS status
FROM features"""
    for c in _FEATURE_COLUMNS
)
_RULES = {
    "year_in_range": "year BETWEEN 1996 AND 2001",
    "country_in_list": f"country IN {_DRIFT}",
    "heading_not_null": "heading IS NOT NULL",
    "actual_not_negative": "actual_meur >= 0",
    "earmarked_not_negative": "earmarked_meur >= 0",
    "rate_in_range": "absorption_rate_pct BETWEEN 0 AND 120",
    "rate_over_100": "absorption_rate_pct <= 100",
    "net_pct_in_range": "net_pct_gni BETWEEN -10 AND 5",
}
_CHECKS = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT ({rule})) AS violations FROM features"
    for name, rule in _RULES.items()
)
_LOF_ROWS = "SELECT country, heading, year, lof_score, lof_anomaly FROM scored"
_ENTITIES = """
FROM total_receipts t LEFT JOIN rev_wide r ON t.year = r.year AND t.country = r.country
"""
_FEATURES = "SELECT * FROM features"

TEXTS = {
    # Sources, ingest, sinks
    "read_cells": """
SELECT sheet, count(s) AS n_text, count(n) AS n_number FROM cells GROUP BY sheet
UNION ALL SELECT 'Notes', CAST(1 AS BIGINT), CAST(0 AS BIGINT)
""",
    "select_year_sheets": "SELECT year, count(*) AS record_count FROM cells GROUP BY year",
    "locate_header": "SELECT sheet, header_row FROM header_row",
    "column_map": "SELECT sheet, key, col_no FROM columns_of",
    "section_marker": """
SELECT sheet, min(row_no) AS marker_row FROM cells WHERE lower(s) LIKE '%nextgenerationeu%' GROUP BY sheet
""",
    "section_terminator": """
SELECT c.sheet, min(row_no) AS end_row FROM cells c JOIN header_row h ON c.sheet = h.sheet
WHERE col_no < 3 AND upper(trim(s)) = 'REVENUE' AND row_no > header_row GROUP BY c.sheet
""",
    "first_mapped_label": """
SELECT sheet, row_no, s AS heading_raw,
  CASE WHEN s IN ('ECONOMY', 'STANDARD') THEN 'Core' WHEN s = 'PROMO' THEN 'Recovery'
    WHEN s = 'SMALL' THEN 'Small' WHEN s = 'MEDIUM' THEN 'Medium' END AS heading
FROM cells WHERE col_no < 4 AND s IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM')
""",
    "row_total_guard": """
SELECT * FROM (SELECT *, max(n) FILTER (WHERE key = '__total__') OVER (PARTITION BY sheet, row_no) AS total
  FROM keyed) q WHERE total IS NOT NULL AND total <> 0
""",
    "row_measure_default": """
SELECT *, coalesce(max(n) FILTER (WHERE key = '__earmarked__') OVER (PARTITION BY sheet, row_no), 0.0) AS earmarked
FROM keyed
""",
    "unpivot_expenditure": "SELECT * FROM sheet_exp",
    "first_text_label": """
SELECT sheet, row_no, min_by(trim(s), col_no) AS label FROM cells
WHERE col_no < 4 AND trim(s) <> '' GROUP BY sheet, row_no
""",
    "unpivot_revenue": "SELECT * FROM sheet_rev",
    "concat_sheets": """
SELECT 'expenditure' AS kind, year, count(*) AS record_count FROM sheet_exp GROUP BY year
UNION ALL SELECT 'revenue', year, count(*) FROM sheet_rev GROUP BY year
""",
    "parsed_heading_level": """
SELECT year, country, heading, CAST(sum(CAST(actual_meur AS DECIMAL(18,4))) AS DOUBLE) AS actual_meur,
  CAST(sum(CAST(earmarked_meur AS DECIMAL(18,4))) AS DOUBLE) AS earmarked_meur,
  max(is_ngeu) AS is_ngeu, max(is_preliminary) AS is_preliminary
FROM sheet_exp GROUP BY year, country, heading
""",
    "parsed_revenue_wide": """
SELECT year, country,
  max(value_meur) FILTER (WHERE metric = 'total_contributions') AS total_contributions,
  max(value_meur) FILTER (WHERE metric = 'gni_size') AS gni_size,
  max(value_meur) FILTER (WHERE metric = 'gni_contribution') AS gni_contribution,
  max(value_meur) FILTER (WHERE metric = 'vat_contribution') AS vat_contribution,
  min_by(value_meur, row_no) FILTER (WHERE metric = 'customs') AS customs,
  CAST(NULL AS DOUBLE) AS total_expenditure
FROM sheet_rev GROUP BY year, country
""",
    "enforce_schema": """
SELECT year, country, heading_raw, heading, CAST(actual_meur AS DOUBLE) AS actual_meur,
  CAST(earmarked_meur AS DOUBLE) AS earmarked_meur, is_ngeu, is_preliminary, row_no FROM exp_raw
""",
    "cache_table": """
SELECT 'is_ngeu' AS by, is_ngeu AS value, count(*) AS n, CAST(sum(actual_meur) AS DOUBLE) AS total
FROM exp_raw GROUP BY is_ngeu
UNION ALL SELECT 'year', year, count(*), CAST(sum(actual_meur) AS DOUBLE) FROM exp_raw GROUP BY year
""",
    "register_view": """
SELECT country, min(year) AS first_year, count(*) AS n FROM exp_raw GROUP BY country
""",
    "create_or_replace_table_as": "SELECT * FROM total_receipts",
    "write_features": _FEATURES,
    "write_scores": "SELECT country, heading, year, lof_score, lof_anomaly, z_anomaly FROM scored",
    "write_h1": _H1,
    "write_ranked": _RANKED,
    "write_audit": _AUDIT,
    "write_summary": _SUMMARY,
    # Projections, filters, predicates
    "project_columns": """
SELECT year, country, heading, absorption_gap_meur, absorption_rate_pct, lag1, lag2, lag3,
  roll_mean_3, zscore_absorption FROM features
""",
    "select_star_plus": """
SELECT *, CAST(actual_meur - earmarked_meur AS DOUBLE) AS over_meur, CAST(year - 2000 AS INT) AS idx
FROM heading_level
""",
    "cte_base": "SELECT * FROM base",
    "exclude_flagged": "SELECT year, country, heading, row_no FROM exp_raw WHERE is_ngeu = 0",
    "h3_working_set": "SELECT country, heading, year, lag1 FROM h3",
    "range_outliers": """
SELECT row_no, CAST(actual_meur AS DOUBLE) AS actual_meur FROM exp_raw, fence
WHERE CAST(actual_meur AS DOUBLE) < q25 - 0.5 * iqr OR CAST(actual_meur AS DOUBLE) > q75 + 0.5 * iqr
""",
    "negative_rows": "SELECT country, heading, year, yoy_change FROM features WHERE yoy_change < 0",
    "entity_subset": f"SELECT * FROM heading_level WHERE country IN {_DRIFT}",
    "latest_period": "SELECT * FROM heading_level WHERE year = (SELECT max(year) FROM heading_level)",
    "flag_split": """
SELECT country, heading, year, CASE lof_anomaly WHEN 1 THEN 'anomaly' WHEN 0 THEN 'normal' END AS side FROM scored
""",
    "fill_constant": """
SELECT country, heading, year, coalesce(lag1, 0.0) AS lag1, coalesce(lag2, -1.0) AS lag2, lag3 FROM base
""",
    "constraint_checks": _CHECKS,
    "min_records_check": """
SELECT year, count(*) AS record_count FROM rev_long GROUP BY year HAVING count(*) < 2000
""",
    # Joins
    "join_revenue": "SELECT * FROM heading_level LEFT JOIN rev_wide USING (year, country)",
    "join_receipts": "SELECT * FROM heading_level LEFT JOIN total_receipts USING (year, country)",
    "lookup_header_join": "SELECT * FROM keyed",
    "crosswalk_join": f"SELECT p_partkey, ({_listed(_LABELS)})[p_partkey % {len(_LABELS)} + 1] AS label, "
    f"({_listed(_HEADINGS)})[p_partkey % {len(_HEADINGS)} + 1] AS heading FROM part",
    # Aggregations
    "heading_level": "SELECT * FROM heading_level",
    "total_receipts": "SELECT * FROM total_receipts",
    "pivot_revenue": "SELECT * FROM rev_wide",
    "null_profile": _NULLS,
    "duplicate_profile": """
SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS "distinct",
  CAST(sum(c) - count(*) AS BIGINT) AS duplicate_count,
  round(100.0 * (sum(c) - count(*)) / CAST(sum(c) AS DOUBLE), 2) AS duplicate_pct,
  CASE WHEN sum(c) = count(*) THEN 'OK' ELSE 'Review' END AS status
FROM (SELECT count(*) AS c FROM exp_raw GROUP BY year, country, heading, is_ngeu, earmarked_meur) q
""",
    "amount_stats": """
SELECT mean, round(stddev, 4) AS stddev, "min", "max", q25, median, q75 FROM amounts
""",
    "fine_sums": """
SELECT l_returnflag, CAST(sum(charge) AS DOUBLE) AS total, CAST(sum(charge) AS DOUBLE) / count(*) AS mean,
  round(sum(share), 6) AS share_total
FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1e9 AS share,
  CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6)) AS charge FROM lineitem) q
GROUP BY l_returnflag
""",
    "discrete_quantiles": """
SELECT CAST(q AS DOUBLE) AS q, v AS value FROM (
  SELECT unnest([0.01, 0.05, 0.5, 0.99]) AS q, unnest(quantile_disc(value_meur, [0.01, 0.05, 0.5, 0.99])) AS v
  FROM rev_long) z
""",
    "exact_quantiles": """
SELECT CAST(q AS DOUBLE) AS q, round(v, 6) AS value FROM (
  SELECT unnest([0.01, 0.05, 0.5, 0.99]) AS q, unnest(quantile_cont(value_meur, [0.01, 0.05, 0.5, 0.99])) AS v
  FROM rev_long) z
""",
    "iqr_outliers": """
SELECT mean, round(stddev, 4) AS stddev, "min", "max", q25, median, q75, iqr,
  q25 - 0.5 * iqr AS lower_bound, q75 + 0.5 * iqr AS upper_bound, outlier_count,
  round(100.0 * outlier_count / CAST(n AS DOUBLE), 4) AS outlier_pct
FROM (SELECT fence.*, (SELECT count(*) FROM exp_raw WHERE CAST(actual_meur AS DOUBLE) < q25 - 0.5 * iqr
  OR CAST(actual_meur AS DOUBLE) > q75 + 0.5 * iqr) AS outlier_count FROM fence) q
""",
    "country_coverage": """
SELECT country, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years_present,
  100.0 * count(DISTINCT year) / CAST(7 AS DOUBLE) AS coverage_pct FROM exp_raw GROUP BY country
""",
    "coverage_summary": """
SELECT count(*) AS n_entities, count(*) FILTER (WHERE y = 7) AS n_full_coverage
FROM (SELECT count(DISTINCT year) AS y FROM exp_raw GROUP BY country) q
""",
    "heading_distribution": """
SELECT heading, count(*) AS record_count, CAST(sum(actual_meur) AS DOUBLE) / count(*) AS avg_amount
FROM exp_raw GROUP BY heading
""",
    "temporal_distribution": "SELECT year, count(*) AS record_count FROM exp_raw GROUP BY year",
    "quality_score": "SELECT * FROM quality_row",
    "audit_document": _AUDIT,
    "audit_scan": _SCAN,
    "h1_collapse": """
SELECT country, year, net_position_meur, net_pct_gni, zscore_net, receipts_meur,
  total_contributions, h1_anomaly FROM h1
""",
    "h1_summary": """
SELECT count(*) AS country_years, CAST(sum(h1_anomaly) AS BIGINT) AS total_anomalies,
  count(DISTINCT country) AS unique_countries FROM h1
""",
    "method_comparison": f"""
SELECT n_total, n_a, n_b, n_both,
  round(100.0 * n_a / CAST(n_total AS DOUBLE), 1) AS pct_a,
  round(100.0 * n_b / CAST(n_total AS DOUBLE), 1) AS pct_b,
  round(100.0 * n_both / CAST(nullif(greatest(n_a, n_b), 0) AS DOUBLE), 1) AS agreement_of_larger_pct,
  round(100.0 * n_both / CAST(greatest(n_a, 1) AS DOUBLE), 1) AS agreement_rate_pct,
  coalesce(round(100.0 * n_both / CAST(nullif(n_a, 0) AS DOUBLE), 1), 0.0) AS precision_pct
FROM (SELECT {_COMPARED} FROM scored) q
""",
    "run_summary": _SUMMARY,
    "rows_by_year": """
SELECT year, count(*) AS record_count, CASE WHEN year BETWEEN 1993 AND 1996 THEN '1993-1996'
  WHEN year BETWEEN 1997 AND 1999 THEN '1997-1999' WHEN year BETWEEN 2000 AND 2006 THEN '2000-2006' END AS mff_period
FROM features GROUP BY year
""",
    "rows_by_entity_year": "SELECT country, "
    + ", ".join(f"count(*) FILTER (WHERE year = {y}) AS y{y}" for y in _YEARS)
    + " FROM exp_raw GROUP BY country",
    "value_counts": "SELECT heading, count(*) AS record_count FROM exp_raw GROUP BY heading",
    "total_by_year_bn": """
SELECT year, CAST(sum(actual_meur) AS DOUBLE) / 1000.0 AS total_bn FROM exp_raw GROUP BY year
""",
    "anomaly_grid": "SELECT country, "
    + ", ".join(
        f"CAST(coalesce(sum(lof_anomaly) FILTER (WHERE year = {y}), 0) AS BIGINT) AS y{y}"
        for y in _YEARS
    )
    + " FROM scored GROUP BY country",
    "mean_rate_by_heading": """
SELECT heading, CAST(sum(CAST(absorption_rate_pct AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_rate_pct
FROM h3 GROUP BY heading
""",
    "anomalies_by_year": """
SELECT year, CAST(sum(lof_anomaly) AS BIGINT) AS anomaly_count FROM scored GROUP BY year
""",
    "unique_headings": "SELECT DISTINCT heading FROM exp_raw ORDER BY heading",
    # Windows
    "yoy_change": "SELECT country, heading, year, yoy_change FROM base",
    "lags_1_2_3": "SELECT country, heading, year, lag1, lag2, lag3 FROM base",
    "rolling_mean_prev3": "SELECT country, heading, year, roll_mean_3 FROM base",
    "lags_by_range": """
SELECT country, row_no, lag(x, 1) OVER w AS lag1, lag(x, 2) OVER w AS lag2, lag(x, 3) OVER w AS lag3
FROM (SELECT country, row_no, CAST(sum(actual_meur) AS DOUBLE) AS x FROM exp_raw GROUP BY country, row_no) q
WINDOW w AS (PARTITION BY country ORDER BY row_no)
""",
    "zscore_absorption": "SELECT country, heading, year, zscore_absorption FROM features",
    "zscore_net": "SELECT country, heading, year, zscore_net FROM features",
    "zscore_lines": """
SELECT row_no, CASE WHEN z = 0 THEN 0.0 ELSE z END AS z FROM (
  SELECT row_no, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 3) AS z
  FROM (SELECT row_no, heading, CAST(actual_meur AS DOUBLE) AS x FROM exp_raw) q
  WINDOW w AS (PARTITION BY heading)) r
""",
    "h1_drift": "SELECT country, year, net_position_lag1, net_position_change FROM h1",
    # Sorts, limits, top-k, sets
    "sort_features": "SELECT * FROM features ORDER BY country, heading, year",
    "ranked_anomalies": _RANKED,
    "top_k_scores": """
SELECT country, heading, year, lof_score,
  country || ' ' || CAST(year AS VARCHAR) || chr(10) || substring(heading, 1, 20) AS label
FROM scored ORDER BY lof_score, country, heading, year LIMIT 10
""",
    "most_normal_scores": """
SELECT country, heading, year, lof_score,
  country || ' ' || CAST(year AS VARCHAR) || chr(10) || substring(heading, 1, 20) AS label
FROM scored ORDER BY lof_score DESC, country, heading, year LIMIT 10
""",
    "sort_net_position": """
SELECT country, year, net_position_meur / 1000.0 AS net_position_bn,
  CASE WHEN net_position_meur > 0 THEN 'receiver' WHEN net_position_meur < 0 THEN 'contributor'
    WHEN net_position_meur = 0 THEN 'balanced' END AS net_status
FROM h1 WHERE year = (SELECT max(year) FROM h1) ORDER BY net_position_bn NULLS LAST, country
""",
    "distinct_rows": """
SELECT year, country, heading_raw, heading, CAST(actual_meur AS DOUBLE) AS actual_meur,
  CAST(earmarked_meur AS DOUBLE) AS earmarked_meur, is_ngeu, is_preliminary, row_no
FROM (SELECT * FROM exp_raw UNION SELECT * FROM exp_raw WHERE is_ngeu = 1) q
""",
    # Scalar functions
    "net_position": f"""
SELECT t.country, t.year, round(receipts_meur - total_contributions, 2) AS net_position_meur {_ENTITIES}
""",
    "net_pct_gni": f"""
SELECT t.country, t.year,
  round((receipts_meur - total_contributions) / nullif(gni_size, 0) * 100, 4) AS net_pct_gni {_ENTITIES}
""",
    "absorption_gap": "SELECT country, heading, year, absorption_gap_meur FROM base",
    "absorption_rate": "SELECT country, heading, year, absorption_rate_pct FROM base",
    "year_index": "SELECT row_no, CAST(year - 2000 AS INT) AS year_index FROM exp_raw",
    "zscore_flag": """
SELECT country, heading, year, CASE WHEN abs(zscore_absorption) > 1.5 THEN 1 ELSE 0 END AS flag FROM features
""",
    "severity_band": """
SELECT country, heading, year,
  CASE WHEN abs(zscore_absorption) > 1.5 THEN 'extreme' WHEN abs(zscore_absorption) > 1.0 THEN 'anomaly'
    WHEN zscore_absorption IS NOT NULL THEN 'normal' END AS z_band,
  CASE WHEN absorption_rate_pct > 100 THEN 'correction' WHEN absorption_rate_pct = 100 THEN 'full'
    WHEN absorption_rate_pct < 95 THEN 'under' WHEN absorption_rate_pct IS NOT NULL THEN 'normal' END AS rate_band
FROM features
""",
    "mff_period": """
SELECT CASE WHEN year BETWEEN 1993 AND 1996 THEN '1993-1996' WHEN year BETWEEN 1997 AND 1999 THEN '1997-1999'
  WHEN year BETWEEN 2000 AND 2006 THEN '2000-2006' END AS period, count(*) AS record_count
FROM exp_raw GROUP BY 1
""",
    "policy_event": """
SELECT CASE year WHEN 1996 THEN 'First' WHEN 1998 THEN 'Second' WHEN 2000 THEN 'Third' END AS event,
  count(*) AS record_count FROM exp_raw GROUP BY 1
""",
    "accession_cohort": """
SELECT CASE WHEN k < 15 THEN 'EU15' WHEN k < 22 THEN 'EU25' WHEN k < 24 THEN 'EU27'
  ELSE 'EU28' END AS cohort, count(*) AS record_count
FROM (SELECT CAST(substring(country, 8) AS INT) AS k FROM exp_raw) q GROUP BY 1
""",
    "net_status": f"""
SELECT t.country, t.year, CASE WHEN round(receipts_meur - gni_size * 10.0, 2) > 0 THEN 'receiver'
  WHEN round(receipts_meur - gni_size * 10.0, 2) < 0 THEN 'contributor'
  WHEN round(receipts_meur - gni_size * 10.0, 2) = 0 THEN 'balanced' END AS status {_ENTITIES}
""",
    "map_heading": f"SELECT p_partkey, ({_listed(_HEADINGS)})[p_partkey % {len(_HEADINGS)} + 1] AS heading FROM part",
    "map_metric": f"SELECT o_orderkey, ({_listed(_METRICS)})[o_orderkey % {len(_METRICS)} + 1] AS metric FROM orders",
    "anomaly_label": """
SELECT row_no, country || ' ' || CAST(year AS VARCHAR) || chr(10) || substring(heading_raw, 1, 20) AS label
FROM exp_raw
""",
    "scale_to_bn": "SELECT country, heading, year, actual_meur / 1000.0 AS actual_bn FROM heading_level",
    "percent_of": """
SELECT country, heading, year, actual_meur * 100.0 / nullif(earmarked_meur, 0) AS pct FROM heading_level
""",
    "format_now": """
SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamp, count(*) AS n FROM orders GROUP BY 1
""",
    "to_json_document": """
SELECT row_no, CAST(to_json({'year': year, 'country': country, 'heading': heading,
  'is_ngeu': is_ngeu, 'is_preliminary': is_preliminary}) AS VARCHAR) AS document FROM exp_raw
""",
    "elementary": """
SELECT row_no, lower(heading_raw) AS lower_text, '  X' || upper(heading_raw) || ' ' AS upper_text,
  heading_raw AS stripped, heading_raw LIKE '%MO%' AS has_mo,
  TRY_CAST(substring(country, 8, 2) AS INT) AS parsed, TRY_CAST(heading_raw AS INT) AS not_parsed,
  abs(CAST(-actual_meur AS DOUBLE)) AS size, round(CAST(actual_meur AS DOUBLE), 1) AS rounded,
  nullif(is_ngeu, 0) AS nullif_zero FROM exp_raw
""",
    # Anomaly detection
    "feature_matrix": """
SELECT country, heading, year, f1 AS absorption_gap_meur, f2 AS absorption_rate_pct, f3 AS lag1,
  f4 AS roll_mean_3 FROM h3
""",
    "local_outlier_factor": _LOF_ROWS,
    "contamination_threshold": """
SELECT round(quantile_cont(CAST(actual_meur AS DOUBLE), 0.05), 6) AS threshold FROM exp_raw
""",
    "zscore_baseline": "SELECT country, year, zscore_net, h1_anomaly FROM h1 WHERE h1_anomaly = 1",
    "features": _FEATURES,
    "features_by_range": _FEATURES,
    # Chart tables
    "net_drift_series": f"""
SELECT country, year, net_position_meur / 1000.0 AS net_position_bn FROM h1 WHERE country IN {_DRIFT}
""",
    "policy_timeline": """
SELECT year, CAST(sum(lof_anomaly) AS BIGINT) AS anomaly_count,
  CASE year WHEN 1996 THEN 'First' WHEN 1998 THEN 'Second' WHEN 2000 THEN 'Third' END AS policy_event
FROM scored GROUP BY year
""",
    "chronic_points": f"""
SELECT country, year, heading, absorption_rate_pct,
  CASE WHEN lof_anomaly = 1 THEN 'anomaly' ELSE 'normal' END AS mark FROM scored WHERE country IN {_CHRONIC}
""",
}

_CUSTOMERS = """
, cust AS (
  SELECT c_custkey AS id, coalesce(any_value(c_acctbal), 0.0) AS f1, CAST(count(o_orderkey) AS DOUBLE) AS f2,
    coalesce(max(o_totalprice), 0.0) AS f3, coalesce(min(o_totalprice), 0.0) AS f4
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
), cust_near AS (
  SELECT id, nbr, d FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, f1, f2, f3, f4, nbr) AS place FROM (
      SELECT a.id, b.id AS nbr, b.f1, b.f2, b.f3, b.f4,
        sqrt((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2)
           + (a.f3-b.f3)*(a.f3-b.f3) + (a.f4-b.f4)*(a.f4-b.f4)) AS d
      FROM cust a JOIN cust b ON a.id <> b.id) q) r
  WHERE place <= 10
), cust_reach AS (
  SELECT id, max(d) AS kdist FROM cust_near GROUP BY id
), cust_density AS (
  SELECT n.id, 1.0 / (avg(greatest(kdist, d)) + 1e-10) AS lrd
  FROM cust_near n JOIN cust_reach r ON n.nbr = r.id GROUP BY n.id
), cust_lof AS (
  SELECT n.id, -avg(o.lrd) / max(p.lrd) AS score
  FROM cust_near n JOIN cust_density o ON n.nbr = o.id JOIN cust_density p ON n.id = p.id GROUP BY n.id
)
SELECT id AS c_custkey, round(score, 6) AS lof_score,
  CASE WHEN score < (SELECT quantile_cont(score, 0.05) FROM cust_lof) THEN 1 ELSE 0 END AS lof_anomaly
FROM cust_lof
"""
TEXTS["lof_over_leaves"] = _CUSTOMERS

TEXTS["lags_by_short_range"] = TEXTS["lags_by_range"]

TEXTS["replace_table_as"] = TEXTS["create_or_replace_table_as"]
TEXTS["write_bucketed_features"] = "SELECT country, heading, year, lag1, lag2, lag3, zscore_absorption FROM features"
_BROKEN = " || ".join(f"CASE WHEN NOT ({rule}) THEN ',{name}' ELSE '' END" for name, rule in _RULES.items())
_PARTED = f"(SELECT country, heading, year, substring({_BROKEN}, 2) AS broken FROM features) parted"
TEXTS["quarantine_rows"] = f"SELECT * FROM {_PARTED} WHERE broken <> ''"
TEXTS["quarantine_counts"] = f"""
{_CHECKS}
UNION ALL SELECT 'kept', count(*) FILTER (broken = '') FROM {_PARTED}
UNION ALL SELECT 'set aside', count(*) FILTER (broken <> '') FROM {_PARTED}
"""
TEXTS["mff_period_table"] = TEXTS["mff_period"]
TEXTS["severity_band_table"] = """
SELECT country, heading, year, CASE WHEN abs(zscore_absorption) >= 1.5 THEN 'extreme'
  WHEN abs(zscore_absorption) >= 1.0 THEN 'anomaly' WHEN zscore_absorption IS NOT NULL THEN 'normal' END AS z_band
FROM features
"""
TEXTS["price_bands"] = """
SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 AND o_totalprice < 120000 THEN 'wide'
  WHEN o_totalprice >= 0 AND o_totalprice < 500000 THEN 'b' || CAST(CAST(floor(o_totalprice / 50) AS BIGINT) AS VARCHAR) END AS band
FROM orders
"""
TEXTS["sketched_quartiles"] = "SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, true AS within"

TEXTS["sheet_layout"] = """
, headers AS (
  SELECT sheet, row_no FROM cells WHERE trim(s) IN ('NATION_0', 'NATION_1', 'Total')
  GROUP BY sheet, row_no HAVING count(DISTINCT trim(s)) = 3
), chosen AS (
  SELECT sheet, min(row_no) AS header_row, coalesce(min(row_no) FILTER (row_no >= 40), min(row_no)) AS revenue_row
  FROM headers GROUP BY sheet
), named AS (
  SELECT sheet, row_no, key, max(col_no) AS col_no FROM (
    SELECT sheet, row_no, col_no, CASE WHEN trim(s) LIKE 'NATION_%' THEN trim(s)
      WHEN trim(s) = 'Total' THEN '__total__' WHEN lower(s) LIKE '%earmarked%' THEN '__earmarked__' END AS key
    FROM cells) q
  WHERE key IS NOT NULL GROUP BY ALL
), listed AS (
  SELECT sheet, row_no, string_agg(key || '=' || col_no, ',' ORDER BY key, col_no) AS columns FROM named GROUP BY ALL
)
SELECT c.sheet, header_row, a.columns AS columns,
  (SELECT min(row_no) FROM cells x WHERE x.sheet = c.sheet AND lower(s) LIKE '%nextgenerationeu%') AS marker_row,
  (SELECT min(row_no) FROM cells x WHERE x.sheet = c.sheet AND row_no > header_row AND col_no < 3 AND upper(trim(s)) = 'REVENUE') AS end_row,
  revenue_row, b.columns AS revenue_columns
FROM chosen c JOIN listed a ON a.sheet = c.sheet AND a.row_no = header_row
JOIN listed b ON b.sheet = c.sheet AND b.row_no = revenue_row
"""

#: The texts that need the forest.
FOREST_TEXTS = {
    "isolation_forest": "SELECT country, heading, year, if_score, if_anomaly FROM h3 JOIN forest USING (id)",
    "absorption_anomalies": "SELECT * FROM both_models",
    "forest_ranked": """
SELECT year, country, heading, absorption_gap_meur, absorption_rate_pct, if_score, lof_anomaly, lof_score
FROM both_models WHERE if_anomaly = 1 ORDER BY if_score, country, heading, year LIMIT 30
""",
    "forest_top_k": TEXTS["top_k_scores"].replace("lof_score", "if_score").replace("scored", "both_models"),
    "forest_grid": TEXTS["anomaly_grid"].replace("lof_anomaly", "if_anomaly").replace("scored", "both_models"),
    "forest_by_year": TEXTS["anomalies_by_year"].replace("lof_anomaly", "if_anomaly").replace("scored", "both_models"),
    "forest_comparison": TEXTS["method_comparison"].replace("z_anomaly", "if_anomaly").replace("FROM scored", "FROM both_models"),
    "forest_summary": _SUMMARY.replace("z_anomaly", "if_anomaly").replace("FROM scored", "FROM both_models"),
}
