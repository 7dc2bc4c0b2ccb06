"""Net-position anomalies (H1) and absorption anomalies (H3) of the feature table."""

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.labels import zscore_flag
from panelspark.operators.forest import isolation_forest
from panelspark.operators.neighbours import LEAF_ROWS, local_outlier_factor
from panelspark.operators.ranking import fill_constant, project_columns
from panelspark.operators.series import lags
from panelspark.schemas import NET_POSITION, SCORED
from panelspark.session import materialize

MODEL_COLS = ["absorption_gap_meur", "absorption_rate_pct", "lag1", "roll_mean_3"]
H3_COLS = [
    "year",
    "country",
    "heading",
    "absorption_gap_meur",
    "absorption_rate_pct",
    "lag1",
    "lag2",
    "lag3",
    "roll_mean_3",
    "zscore_absorption",
]
H1_MEASURES = [
    "net_position_meur",
    "net_pct_gni",
    "zscore_net",
    "receipts_meur",
    "total_contributions",
]


def h1_collapse(features: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row per (country, year): the measures are constant within it."""
    measures = [F.max(c).alias(c) for c in H1_MEASURES]
    flat = features.groupBy("country", "year").agg(*measures)
    return flat.withColumn("h1_anomaly", zscore_flag("zscore_net", threshold))


def h1_drift(h1: DataFrame, chunk: int | None = None) -> DataFrame:
    """Net position of the row before, and the change since."""
    found = lags(
        h1, "net_position_meur", ["country"], "year", 1, prefix="net_position_lag", chunk=chunk
    )
    change = F.col("net_position_meur") - F.col("net_position_lag1")
    return found.withColumn("net_position_change", change)


def net_positions(
    features: DataFrame, threshold: float = 2.0, chunk: int | None = None
) -> DataFrame:
    h1 = h1_drift(h1_collapse(features, threshold), chunk)
    return h1.select(*[F.col(f.name).cast(f.dataType) for f in NET_POSITION.fields])


def h1_summary(h1: DataFrame) -> DataFrame:
    return h1.agg(
        F.count("*").alias("country_years"),
        F.sum(F.col("h1_anomaly").cast("long")).alias("total_anomalies"),
        F.countDistinct("country").alias("unique_countries"),
    )


def h3_working_set(features: DataFrame) -> DataFrame:
    """Settled rows outside the flagged section that have an earlier row."""
    return features.where(
        (F.col("is_ngeu") == 0) & (F.col("is_preliminary") == 0) & F.col("lag1").isNotNull()
    )


def absorption_set(features: DataFrame) -> DataFrame:
    """The scored columns; only the rate is filled here, the model fills the rest."""
    rows = project_columns(h3_working_set(features), H3_COLS)
    return fill_constant(rows, {"absorption_rate_pct": 0.0})


def absorption_anomalies(
    features: DataFrame,
    trees: int = 100,
    k: int = 20,
    contamination: float = 0.05,
    seed: int = 42,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Both model scores and flags per row of the working set."""
    rows = materialize(absorption_set(features), "absorption")
    key = ["country", "heading", "year"]
    forest = isolation_forest(
        rows, MODEL_COLS, key, trees=trees, seed=seed, contamination=contamination
    )
    scored = local_outlier_factor(forest, MODEL_COLS, k, contamination, leaf_rows)
    return scored.select(*[F.col(f.name).cast(f.dataType) for f in SCORED.fields])
