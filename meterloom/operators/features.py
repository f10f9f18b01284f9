"""Leakage-safe features of a daily target, demand regimes, and the audit of feature availability."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.clock import add_calendar
from meterloom.functions.names import EXOGENOUS_TERMS, exogenous_features, ordered_union
from meterloom.operators.daily import densify
from meterloom.operators.series import Keys, attach, by_series, join_series, numbered, own_rows, split_window, with_halo
from meterloom.session import cut_lineage

# Lags, rolling windows (statistic, length, fewest known values) and calendar features.
LAGS = [1, 2, 3, 7, 14, 28, 365]
ROLLING = {
    "rolling_7_mean": ("mean", 7, 3),
    "rolling_14_mean": ("mean", 14, 7),
    "rolling_30_mean": ("mean", 30, 14),
    "rolling_7_max": ("max", 7, 3),
    "rolling_30_max": ("max", 30, 14),
}
CALENDAR = ["month", "day_of_week", "quarter", "is_weekend", "is_winter", "is_summer", "is_peak_season"]


def history_columns(target: str, window) -> dict[str, Column]:
    """Lag and rolling expressions over rows strictly before the current one."""
    columns = {f"lag_{k}": F.lag(target, k).over(window) for k in LAGS}
    for name, (statistic, length, fewest) in ROLLING.items():
        past = window.rowsBetween(-length, -1)
        value = F.max(target).over(past) if statistic == "max" else F.avg(target).over(past)
        columns[name] = F.when(F.count(target).over(past) >= fewest, value)
    return columns


def history_features(
    df: DataFrame, target: str, keys: Keys = (), mode: str = "rows", block: int | None = None,
    order: str = "date", bucket: Column | None = None,
) -> DataFrame:
    """Lags and shifted rolling statistics.

    ``mode="rows"`` counts table rows in the order of ``order``; ``mode="calendar"`` counts days, so a missing day gives
    a null lag. With ``block`` a series is split into blocks of that many rows (or days), for series too long for one
    task; all features share one window and one shuffle either way. Blocks of rows need row numbers, which are counted
    bucket by bucket: ``bucket`` must not decrease along ``order`` and is the year of the date unless given.
    """
    if mode not in ("rows", "calendar"):
        raise ValueError("mode must be rows or calendar")
    if mode == "rows" and block is None:
        return df.withColumns(history_columns(target, by_series(keys, order)))
    if mode == "rows":
        placed = numbered(df, keys, [order], F.year(order) if bucket is None else bucket)
        split = with_halo(placed, "_pos", block, max(LAGS))
        return own_rows(split.withColumns(history_columns(target, split_window(keys)))).drop("_pos")
    marked = densify(df.withColumn("_real", F.lit(True)), keys)
    if block is None:
        full = marked.withColumns(history_columns(target, by_series(keys)))
    else:
        placed = marked.withColumn("_pos", F.unix_date("date").cast("long"))
        split = with_halo(placed, "_pos", block, max(LAGS))
        full = own_rows(split.withColumns(history_columns(target, split_window(keys)))).drop("_pos")
    return full.where("_real").drop("_real")


def train_quartiles(df: DataFrame, target: str, start: str, keys: Keys = ()) -> DataFrame:
    """First and third quartile of the days before ``start``; one row per series."""
    return df.where(F.col("date") < F.lit(start).cast("date")).groupBy(*keys).agg(
        F.percentile(target, F.lit(0.25)).alias("low_threshold"),
        F.percentile(target, F.lit(0.75)).alias("high_threshold"),
    )


def training_regime(
    df: DataFrame, target: str, start: str, keys: Keys = (), keep_thresholds: bool = False
) -> DataFrame:
    """Regime against training quartiles, boundaries counting as normal."""
    y = F.col(target)
    labelled = attach(df, train_quartiles(df, target, start, keys), keys).withColumn(
        "demand_regime",
        F.when(y < F.col("low_threshold"), "low").when(y > F.col("high_threshold"), "high").otherwise("normal"),
    )
    return labelled if keep_thresholds else labelled.drop("low_threshold", "high_threshold")


def evaluation_regime(df: DataFrame, actual: str = "actual", keys: Keys = ()) -> DataFrame:
    """Regime against the quartiles of the evaluated actuals themselves, boundaries counting as low or high."""
    days = df.select(*keys, "date", actual).distinct()
    cuts = days.groupBy(*keys).agg(
        F.percentile(actual, F.lit(0.25)).alias("_q25"), F.percentile(actual, F.lit(0.75)).alias("_q75")
    )
    y = F.col(actual)
    return attach(df, cuts, keys).withColumn(
        "demand_regime",
        F.when(y <= F.col("_q25"), "low").when(y >= F.col("_q75"), "high").otherwise("normal"),
    ).drop("_q25", "_q75")


def feature_frame(
    df: DataFrame, target: str, start: str, keys: Keys = (), mode: str = "rows", block: int | None = None,
) -> DataFrame:
    """History, calendar and regime columns next to the daily table; ``block`` as in :func:`history_features`."""
    featured = add_calendar(history_features(df, target, keys, mode, block), only=CALENDAR)
    return training_regime(featured, target, start, keys)


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """Model inputs present in the table: history, calendar, then outside influences."""
    known = [*[f"lag_{k}" for k in LAGS], *ROLLING, *CALENDAR]
    return ordered_union([c for c in known if c in df.columns], exogenous_features(df, target))


def is_observed_exogenous(name: str) -> bool:
    """Realised on the day itself; capacity columns count as planned."""
    return any(t in name for t in EXOGENOUS_TERMS) and "capacity" not in name


def strict_columns(columns: list[str], mode: str = "drop") -> list[str]:
    """Inputs allowed when forecasting without same-day observations (``drop``) or with them (``actual``)."""
    if mode not in ("drop", "actual"):
        raise ValueError("mode must be drop or actual")
    return [c for c in columns if mode == "actual" or not is_observed_exogenous(c)]


# Attributes of each availability class.
AUDIT_FIELDS = [
    "feature_type", "uses_target_history", "uses_same_day_observed_value", "known_at_forecast_time",
    "safe_for_one_day_ahead", "safe_for_strict_multi_step", "notes",
]
AUDIT_CLASSES = {
    "target lag": (
        True, False, "yes for one-day-ahead; recursively generated for multi-step", True, False,
        "Uses demand observed before the forecast date. Safe for next-day forecasting, but future lags "
        "must be generated recursively for a full test-period forecast.",
    ),
    "rolling target history": (
        True, False, "yes for one-day-ahead; recursively generated for multi-step", True, False,
        "Calculated from shifted historical demand. It must use model forecasts, not actual future "
        "demand, in strict recursive evaluation.",
    ),
    "calendar": (
        False, False, "yes", True, True, "Calendar values are known for future dates.",
    ),
    "capacity variable": (
        False, True, "usually planned or scenario-specified", True, True,
        "Capacity is more likely to be known or planned than realised generation, but this should still "
        "be checked before operational use.",
    ),
    "observed exogenous variable": (
        False, True, "only if forecasted or scenario-specified", False, False,
        "Realised same-day generation or flow values are retrospective unless replaced by forecasts, "
        "schedules or scenario assumptions.",
    ),
    "other": (
        False, False, "review required", False, False,
        "Feature was not recognised by the audit rules and should be reviewed manually.",
    ),
}


def availability_class(name: str) -> str:
    """Class of a feature by its name; the first rule that applies decides."""
    if re.fullmatch(r"lag_\d+", name):
        return "target lag"
    if name in ROLLING:
        return "rolling target history"
    if name in CALENDAR:
        return "calendar"
    if "capacity" in name:
        return "capacity variable"
    return "observed exogenous variable" if any(t in name for t in EXOGENOUS_TERMS) else "other"


def feature_audit(spark: SparkSession, columns: list[str], strict_mode: str = "drop") -> DataFrame:
    """Availability of every distinct feature at forecast time, and whether the strict run may use it."""
    strict = set(strict_columns(columns, strict_mode))
    rows = [
        (name, kind, *AUDIT_CLASSES[kind], name in strict)
        for name in dict.fromkeys(columns)
        for kind in [availability_class(name)]
    ]
    return spark.createDataFrame(
        rows,
        "feature string, feature_type string, uses_target_history boolean, "
        "uses_same_day_observed_value boolean, known_at_forecast_time string, "
        "safe_for_one_day_ahead boolean, safe_for_strict_multi_step boolean, notes string, "
        "included_in_strict_recursive_run boolean",
    )


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("feature_type", "safe_for_one_day_ahead", "safe_for_strict_multi_step").agg(
        F.count(F.lit(1)).alias("features")
    )


def leakage_check(featured: DataFrame, target: str, keys: Keys = (), tolerance: float = 1e-6) -> DataFrame:
    """Recompute history features from earlier rows only and count rows that disagree.

    Rows are numbered and packed into arrays of as many rows as the longest lag; an array and the one before hold all
    that a row's features may come from, found by place and strictly before the row, so a feature that has seen its own
    day cannot match. A row is shuffled once with its features and its target once more. No window function of
    the target takes part.
    """
    expected = [*[f"lag_{k}" for k in LAGS], *ROLLING]
    size = max(*LAGS, *[length for _, length, _ in ROLLING.values()])
    placed = featured.withColumn("_n", F.row_number().over(by_series(keys)) - 1).select(
        *keys, F.floor(F.col("_n") / size).alias("_part"), "_n", F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double") for c in expected])
    parts = cut_lineage(placed.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(F.struct("_n", "_y", *expected))).alias("_rows")))
    values = F.transform("_rows", lambda row: row["_y"])
    before = parts.select(*keys, (F.col("_part") + 1).alias("_part"), values.alias("_before"))
    joined = join_series(parts, before, keys, ["_part"])
    earlier = F.coalesce("_before", F.array().cast("array<double>"))
    joined = joined.select("_rows", F.size(earlier).alias("_lent"), F.concat(earlier, values).alias("_past"))

    def rolled(place: Column, statistic: str, length: int, fewest: int) -> Column:
        start = F.greatest(place - length, F.lit(0))
        recent = F.filter(F.slice("_past", start + 1, place - start), lambda v: v.isNotNull())
        value = F.array_max(recent) if statistic == "max" else F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / F.size(recent)
        return F.when(F.size(recent) >= fewest, value)

    def differs(row: Column, name: str, again: Column) -> Column:
        far = F.coalesce(F.abs(row[name] - again) > tolerance, F.lit(False))
        return (row[name].isNull() != again.isNull()) | far

    def judged(row: Column, i: Column) -> Column:
        place = F.col("_lent") + i
        again = {f"lag_{k}": F.get("_past", place - k) for k in LAGS} | {name: rolled(place, *rule) for name, rule in ROLLING.items()}
        return F.struct(*[row[name].isNotNull().alias(f"n_{name}") for name in expected], *[differs(row, name, again[name]).alias(f"m_{name}") for name in expected])

    wide = joined.select(F.inline(F.transform("_rows", judged))).groupBy().agg(
        *[F.count_if(F.col(f"{c}_{name}")).alias(f"{c}_{name}") for c in "nm" for name in expected])
    return wide.select(F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("feature"), F.col(f"n_{name}").alias("rows_checked"),
            F.col(f"m_{name}").alias("mismatches"),
        )
        for name in expected
    ])).alias("e")).select("e.*")
