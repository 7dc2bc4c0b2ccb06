"""Labels, bands and flags attached to a value."""

from pyspark.sql import Column, functions as F

from panelspark.functions.exprs import column

# Countries by accession cohort.
COHORTS = [
    ("EU15", ["BE", "DK", "DE", "EL", "ES", "FR", "IE", "IT", "LU", "NL", "AT", "PT", "FI", "SE", "UK"]),
    ("EU25", ["CY", "CZ", "EE", "HU", "LT", "LV", "MT", "PL", "SI", "SK"]),
    ("EU27", ["BG", "RO"]),
    ("EU28", ["HR"]),
]
COUNTRIES = [country for _, members in COHORTS for country in members]

# Multi-annual budget periods, both ends included.
BUDGET_PERIODS = [
    (2000, 2006, "2000-2006"),
    (2007, 2013, "2007-2013"),
    (2014, 2020, "2014-2020"),
    (2021, 2027, "2021-2027"),
]

# Years marked on the anomaly time line.
POLICY_EVENTS = [
    (2004, "EU Enlargement (2004)"),
    (2008, "Financial Crisis (2008)"),
    (2020, "COVID-19 (2020)"),
]

# Countries of the drift chart and of the absorption chart.
DRIFT_COUNTRIES = ["DE", "FR", "IT", "PL", "ES", "NL"]
CHRONIC_COUNTRIES = ["ES", "IT", "PL", "RO"]


def zscore_flag(z: Column | str, threshold: float = 2.0) -> Column:
    """1 where |z| exceeds the threshold; an undefined z is not an anomaly."""
    return F.when(F.abs(column(z)) > F.lit(threshold), 1).otherwise(0)


def severity_band(z: Column | str, high: float = 2.0, extreme: float = 3.0) -> Column:
    size = F.abs(column(z))
    return (
        F.when(size > extreme, "extreme")
        .when(size > high, "anomaly")
        .when(size.isNotNull(), "normal")
    )


def absorption_band(rate: Column | str, low: float = 85.0) -> Column:
    rate = column(rate)
    return (
        F.when(rate > 100.0, "correction")
        .when(rate == 100.0, "full")
        .when(rate < low, "under")
        .when(rate.isNotNull(), "normal")
    )


def mff_period(year: Column | str, periods=BUDGET_PERIODS) -> Column:
    year = column(year)
    return F.coalesce(*[F.when(year.between(a, b), name) for a, b, name in periods])


def policy_event(year: Column | str, events=POLICY_EVENTS) -> Column:
    year = column(year)
    return F.coalesce(*[F.when(year == y, name) for y, name in events])


def accession_cohort(country: Column | str, cohorts=COHORTS) -> Column:
    country = column(country)
    return F.coalesce(*[F.when(country.isin(members), name) for name, members in cohorts])


def net_status(net: Column | str) -> Column:
    net = column(net)
    return (
        F.when(net > 0, "receiver").when(net < 0, "contributor").when(net == 0, "balanced")
    )


def anomaly_label(country: Column | str, year: Column | str, heading: Column | str) -> Column:
    head = F.concat_ws(" ", column(country), column(year).cast("string"))
    return F.concat_ws("\n", head, F.substring(column(heading), 1, 20))
