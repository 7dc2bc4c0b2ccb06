"""Budget-shaped tables derived from the star schema (orders, line items, parts).

Nations stand for countries, order years for years, part types for headings and
order priorities for revenue metrics.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.functions.crosswalk import map_heading
from panelspark.functions.exprs import exact_sum, exact_sum_decimal, round_amount
from panelspark.session import materialize

HEADING_RULES = [
    ("economy", "Core"),
    ("standard", "Core"),
    ("promo", "Recovery"),
    ("small", "Small"),
    ("medium", "Medium"),
]
METRIC_OF_PRIORITY = {
    "1-URGENT": "total_contributions",
    "2-HIGH": "gni_contribution",
    "3-MEDIUM": "vat_contribution",
    "4-NOT SPECIFIED": "customs",
    "5-LOW": "gni_size",
}
LABEL_OF_PRIORITY = {
    "1-URGENT": "TOTAL national contribution",
    "2-HIGH": "GNI-based own resource",
    "3-MEDIUM": "VAT-based own resource",
    "4-NOT SPECIFIED": "Customs duties",
    "5-LOW": "Gross National Income",
}
# Texts as sheets word them: every rule of the crosswalks, two rules at once, and none.
HEADING_LABELS = [
    "1. Agriculture and rural development",
    "Preservation and management of resources",
    "NATURAL RESOURCES and environment",
    "2. Structural actions",
    "1. Sustainable growth",
    "1.1 Smart and inclusive growth",
    "2. Cohesion, resilience and values",
    "3. Internal policies",
    "1. Single Market, Innovation and Digital",
    "4. External actions",
    "4. EU as a global player",
    "Global Europe",
    "6. Neighbourhood and the world",
    "7. European public administration",
    "3. Citizenship, freedom, security and justice",
    "3. Security and citizenship",
    "4. Migration and border management",
    "5. Security and defence",
    "7. Pre-accession strategy",
    "of which NextGenerationEU",
    "Sustainable growth: natural resources",
    "Administration and security and defence",
    "Other items",
]
METRIC_LABELS = [
    "TOTAL national contribution (1)",
    "total national contributions",
    "GNP-based own resource",
    "GNI-based own resource",
    "Own resources based on GNI",
    "VAT-based own resource",
    "own resources based on VAT",
    "Traditional own resources (TOR)",
    "Customs duties",
    "Gross National Income",
    "Total expenditure",
    "Customs duties and GNI-based own resource",
    "Rebate",
]
NATIONS = [f"NATION_{i}" for i in range(25)]
HEADER_KEYS = ("NATION_0", "NATION_1", "Total")
PRELIMINARY_YEAR = 2001
# Decimals of the amounts these tables hold.
DIGITS = 4


# Declared, so that opening a table starts no job to read file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def choose(col, values: dict[str, str], default=None):
    """Value of a fixed table as one CASE expression."""
    chain = None
    for key, value in values.items():
        chain = F.when(F.col(col) == key, value) if chain is None else chain.when(F.col(col) == key, value)
    return chain if default is None else chain.otherwise(default)


def _orders_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .withColumn("year", F.year("o_orderdate").cast("int"))
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with year, nation, part type and amounts of four digits."""
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flagged = (
        (F.col("p_type") == "PROMO") & (F.col("year") >= 2000) & (F.col("l_linestatus") == "O")
    )
    orders = _orders_by_nation(spark, folder).select(
        "o_orderkey", "year", "n_name", "n_nationkey"
    )
    return (
        table(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "year",
            "n_name",
            "n_nationkey",
            "p_type",
            round_amount(amount, DIGITS).alias("actual"),
            round_amount("l_extendedprice", DIGITS).alias("earmarked"),
            F.when(flagged, 1).otherwise(0).alias("is_ngeu"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        )
    )


def expenditure(spark: SparkSession, folder: str) -> DataFrame:
    heading = map_heading("p_type", HEADING_RULES)
    lines = _lines(spark, folder).withColumn("heading", heading)
    return lines.where(F.col("heading").isNotNull()).select(
        "year",
        F.col("n_name").alias("country"),
        F.col("p_type").alias("heading_raw"),
        "heading",
        F.col("actual").alias("actual_meur"),
        F.col("earmarked").alias("earmarked_meur"),
        "is_ngeu",
        F.when(F.col("year") == PRELIMINARY_YEAR, 1).otherwise(0).alias("is_preliminary"),
        "row_no",
    )


def expenditure_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as a sheet may leave them: some without amounts, some without a heading."""
    gap = F.when(F.col("row_no") % 11 != 3, F.col("actual_meur")).alias("actual_meur")
    plan = F.when(F.col("row_no") % 3 != 1, F.col("earmarked_meur")).alias("earmarked_meur")
    name = F.when(F.col("row_no") % 50 != 2, F.col("heading")).alias("heading")
    changed = {"actual_meur": gap, "earmarked_meur": plan, "heading": name}
    rows = expenditure(spark, folder)
    return rows.select(*[changed.get(c, F.col(c)) for c in rows.columns])


def revenue(spark: SparkSession, folder: str) -> DataFrame:
    priorities = dict(METRIC_OF_PRIORITY)
    default = priorities.pop("5-LOW")
    return _orders_by_nation(spark, folder).select(
        "year",
        F.col("n_name").alias("country"),
        choose("o_orderpriority", priorities, default).alias("metric"),
        F.col("o_totalprice").alias("value_meur"),
        F.col("o_orderkey").alias("row_no"),
    )


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer the balance and the number, largest and smallest of the orders."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n_orders"),
        F.max("o_totalprice").alias("largest"),
        F.min("o_totalprice").alias("smallest"),
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def _one_of(texts: list[str], key: str):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(key) % len(texts) + 1).cast("int"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with a heading text each; one of them maps to nothing."""
    return table(spark, folder, "part").select("p_partkey", _one_of(HEADING_LABELS, "p_partkey").alias("label"))


def metric_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a revenue text each; one of them maps to nothing."""
    return table(spark, folder, "orders").select("o_orderkey", _one_of(METRIC_LABELS, "o_orderkey").alias("label"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet per order year.

    Row 3 is the header: nations in columns 4-28, total in 29, earmarked in 30.
    From row 4 a row per part type, from row 20 the marked section, at row 40 the
    terminator, at row 41 the second header and below it the revenue rows; two of
    them map to the same metric.
    """
    sums = materialize(
        _lines(spark, folder)
        .groupBy("year", "n_nationkey", "p_type", "is_ngeu")
        .agg(exact_sum_decimal("actual", DIGITS).alias("v"), exact_sum_decimal("earmarked", DIGITS).alias("e")),
        "sums",
    )
    place = Window.partitionBy("year", "is_ngeu").orderBy("p_type")
    rows = (
        sums.groupBy("year", "p_type", "is_ngeu")
        .agg(F.sum("v").cast("double").alias("tv"), F.sum("e").cast("double").alias("te"))
        .withColumn("row_no", 3 + 17 * F.col("is_ngeu") + F.row_number().over(place))
    )
    money = materialize(
        _orders_by_nation(spark, folder)
        .groupBy("year", "n_nationkey", "o_orderpriority")
        .agg(exact_sum("o_totalprice", DIGITS).alias("v")),
        "money",
    )
    revenue_row = 42 + F.substring("o_orderpriority", 1, 1).cast("int")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    years = sums.select("year").distinct()
    # Two header rows per sheet: one entry per nation (25 rows), total and earmarked.
    names = nation.select((4 + F.col("n_nationkey")).alias("c"), F.col("n_name").alias("t"))
    extra = F.array(
        F.struct(F.lit(29).alias("c"), F.lit("Total").alias("t")),
        F.struct(F.lit(30).alias("c"), F.lit("Earmarked (all)").alias("t")),
    )
    heads = names.agg(F.collect_list(F.struct("c", "t"))).scalar()

    def cell(df: DataFrame, row, col, s=None, n=None) -> DataFrame:
        return df.select(
            F.col("year").cast("string").alias("sheet"),
            (F.lit(row) if isinstance(row, int) else row).cast("int").alias("row_no"),
            (F.lit(col) if isinstance(col, int) else col).cast("int").alias("col_no"),
            (F.lit(None) if s is None else s).cast("string").alias("s"),
            (F.lit(None) if n is None else n).cast("double").alias("n"),
        )

    row, nation_col = F.col("row_no"), 4 + F.col("n_nationkey")
    header = years.select("year", F.inline(F.concat(heads, extra)))
    second = years.select("year", F.inline(heads))
    values = sums.join(rows, ["year", "p_type", "is_ngeu"])
    revenue_labels = money.select("year", "o_orderpriority").distinct()
    text = choose("o_orderpriority", LABEL_OF_PRIORITY)
    twice = money.where(F.col("o_orderpriority") == "3-MEDIUM")
    parts = [
        cell(header, 3, F.col("c"), F.col("t")),
        cell(rows, row, 1, F.col("p_type")),
        cell(values, row, nation_col, None, F.col("v")),
        cell(rows, row, 29, None, F.col("tv")),
        cell(rows, row, 30, None, F.col("te")),
        cell(rows.where("is_ngeu = 1").select("year").distinct(), 20, 2, F.lit("NextGenerationEU (NGEU)")),
        cell(years, 40, 0, F.lit("Revenue ")),
        cell(second, 41, F.col("c"), F.col("t")),
        cell(years, 41, 29, F.lit("Total")),
        cell(revenue_labels, revenue_row, 0, text),
        cell(money, revenue_row, nation_col, None, F.col("v")),
        cell(years, 60, 0, F.lit("Traditional own resources")),
        cell(twice, 60, nation_col, None, F.col("v")),
    ]
    grid = parts[0]
    for other in parts[1:]:
        grid = grid.unionByName(other)
    note = spark.range(1).select(
        F.lit("Notes").alias("sheet"),
        F.lit(0).alias("row_no"),
        F.lit(0).alias("col_no"),
        F.lit("not a year").alias("s"),
        F.lit(None).cast("double").alias("n"),
    )
    return grid.unionByName(note)
