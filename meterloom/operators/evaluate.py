"""Forecast tables, metrics, error slices, benchmarks and design comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.errors import error_columns, metric_aggregates
from meterloom.functions.stats import pearson
from meterloom.operators.features import evaluation_regime
from meterloom.operators.series import Keys, by_series, join_series, numbered, own_rows, split_window, with_halo
from meterloom.sources.tables import require_columns

# Forecast columns known to the diagnostics, and the stable order of models and regimes.
FORECAST_COLUMNS = [
    "seasonal_naive_forecast", "sarima_forecast", "sarimax_forecast", "holt_winters_forecast", "naive_forecast",
]
MODEL_ORDER = ["naive", "seasonal_naive", "holt_winters", "sarima", "sarimax"]
REGIME_ORDER = ["low", "normal", "high"]
OPERATIONAL_DESIGN = "operational_one_day_ahead"
OPERATIONAL_NOTE = (
    "Valid next-day operational forecast design, not a full-year-ahead forecast from the first test date."
)
SLICES = ["month", "day_of_week", "demand_regime", "quarter", "is_weekend"]


def merge_forecasts(first: DataFrame, *others: DataFrame, keys: Keys = ()) -> DataFrame:
    """Add the forecast columns of other tables by date; ``actual`` comes from the first table that has it."""
    merged = first
    for other in others:
        new = [c for c in other.columns if c not in merged.columns and (c == "actual" or c.endswith("_forecast"))]
        merged = join_series(merged, other.select(*keys, "date", *new), keys, ["date"])
    return merged


def aligned(actual: DataFrame, forecast: DataFrame, keys: Keys = ()) -> DataFrame:
    """Days present on both sides."""
    return join_series(actual, forecast, keys, ["date"], "inner")


def long_forecasts(wide: DataFrame, keys: Keys = (), keep: list[str] | None = None) -> DataFrame:
    """One row per day and model from ``<model>_forecast`` columns."""
    require_columns(wide, "actual")
    models = [c for c in wide.columns if c.endswith("_forecast")]
    return wide.unpivot([*keys, "date", "actual", *(keep or [])], models, "model", "forecast").withColumn(
        "model", F.regexp_replace("model", "_forecast$", "")
    )


def with_errors(long: DataFrame) -> DataFrame:
    return long.withColumns(error_columns(F.col("actual"), F.col("forecast")))


def metrics(long: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, MAPE and row count per group."""
    return long.groupBy(*by).agg(
        *metric_aggregates(F.col("actual"), F.col("forecast")), F.count(F.lit(1)).alias("rows")
    )


def ranked(
    table: DataFrame, by: str, keys: Keys = (), ascending: bool = True, tie: str = "model", absolute: bool = False
) -> DataFrame:
    """Order a table of a few rows per series and say the place of each row; ``absolute`` ignores signs."""
    value = F.abs(by) if absolute else F.col(by)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)))


def in_model_order(table: DataFrame, models: list[str] = MODEL_ORDER) -> DataFrame:
    """Keep the listed models and number them in the given order."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model")).cast("int")
    return table.where(F.col("model").isin(models)).withColumn("model_order", place - 1)


def period_columns(errors: DataFrame, keys: Keys = ()) -> DataFrame:
    """Month, quarter, weekday, weekend flag and evaluation regime."""
    day = F.col("date")
    return evaluation_regime(errors, "actual", keys).withColumns({
        "month": F.month(day), "quarter": F.quarter(day),
        "day_of_week": F.weekday(day), "is_weekend": F.weekday(day) >= 5,
    })


def error_slices(errors: DataFrame, keys: Keys = (), slices: list[str] = SLICES) -> DataFrame:
    """Mean error, MAE and MAPE per slice value and model, for all slices in one aggregation.

    Rows are reduced to partial sums per combination of slice values first; the slices are then summed
    over those, so no row is copied once per slice.
    """
    e = period_columns(errors, keys)
    parts = e.groupBy(*keys, "model", *slices).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_s_{c}") for c in ERROR_MEASURES],
        *[F.count(c).alias(f"_n_{c}") for c in ERROR_MEASURES],
    )
    long = parts.select("*", F.explode(F.array(*[
        F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("slice_value")) for s in slices
    ])).alias("_e"))
    mean = lambda c: F.sum(f"_s_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))
    return long.groupBy(*keys, F.col("_e.slice").alias("slice"), F.col("_e.slice_value").alias("slice_value"), "model").agg(
        F.sum("_rows").alias("rows"),
        *[mean(c).alias(n) for c, n in zip(ERROR_MEASURES, ("mean_error", "mae", "mape"))],
    )


ERROR_MEASURES = ("error", "absolute_error", "absolute_percentage_error")


def slice_pivot(table: DataFrame, slice_name: str, value: str, models: list[str], keys: Keys = ()) -> DataFrame:
    """One row per slice value and one column per model."""
    picked = table.where(F.col("slice") == slice_name)
    return picked.groupBy(*keys, "slice_value").pivot("model", models).agg(F.first(value))


def incomplete_day_impact(errors: DataFrame, daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Coverage of each evaluated day next to the absolute error of each model."""
    coverage = [
        c for c in ("settlement_period_count", "expected_settlement_period_count", "coverage_ratio", "has_incomplete_day")
        if c in daily.columns
    ]
    return join_series(
        errors.select(*keys, "date", "model", "actual", "absolute_error"), daily.select(*keys, "date", *coverage), keys, ["date"]
    )


def residual_autocorrelation(
    errors: DataFrame, keys: Keys = (), max_lag: int = 30, order: str = "date", bucket: Column | None = None, block: int = 10_000,
) -> DataFrame:
    """Correlation of the errors of a model with its own earlier errors, nulls removed first.

    With ``bucket``, which must not decrease along ``order``, errors may be finer than daily: rows are numbered bucket by
    bucket and cut into blocks that lend each other the rows of the largest lag, and the lagged products of all blocks
    are added up.
    """
    group = [*keys, "model"]
    known = errors.where(F.col("error").isNotNull())
    lags = range(1, max_lag + 1)
    lagged = lambda line: {f"_l{k}": F.lag("error", k).over(line) for k in lags}
    if bucket is None:
        shifted = known.withColumns(lagged(by_series(group, order)))
    else:
        placed = with_halo(numbered(known.select(*group, order, "error"), group, [order], bucket), "_pos", block, max_lag)
        shifted = own_rows(placed.withColumns(lagged(split_window(group))))
    wide = shifted.groupBy(*group).agg(*[pearson("error", f"_l{k}").alias(f"_l{k}") for k in lags])
    return wide.unpivot(group, [f"_l{k}" for k in lags], "lag", "autocorrelation").withColumn(
        "lag", F.substring("lag", 3, 9).cast("int")
    )


def verdicts(table: DataFrame, benchmark: str = "seasonal_naive", keys: Keys = ()) -> DataFrame:
    """Whether each other model beats the benchmark on MAE. A metric table holds a few rows per series."""
    series = Window.partitionBy(*keys)
    reference = F.max(F.when(F.col("model") == benchmark, F.col("mae"))).over(series)
    judged = table.withColumn("benchmark_mae", reference)
    return judged.where(F.col("model") != benchmark).select(
        *keys, "model", "mae", "benchmark_mae",
        F.when(F.col("mae") < F.col("benchmark_mae"), "beats").otherwise("does not beat").alias("verdict"),
    )


def stacked(*tables: DataFrame) -> DataFrame:
    """Union by name with the place of the source table as ``priority``; absent columns are null."""
    out = None
    for place, table in enumerate(tables):
        tagged = table.withColumn("priority", F.lit(place))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def keep_by_priority(table: DataFrame, by: list[str], last: bool = True, priority: str = "priority") -> DataFrame:
    """One row per group: of the last source that has it, or of the first."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in table.columns if c not in by]
    return table.groupBy(*by).agg(pick(F.struct(*rest), priority).alias("_r")).select(*by, "_r.*")


def operational_summary(
    table: DataFrame, target: str, start: str, end: str, models: list[str], keys: Keys = ()
) -> DataFrame:
    """Saved metrics of the listed models, labelled as the one-day-ahead design; absent models keep nulls."""
    if keys:
        named = table.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, models))).alias("model"))
    else:
        named = table.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return join_series(named, table.select(*keys, "model", "mae", "rmse", "mape"), keys, ["model"]).select(
        *keys, F.lit(target).alias("target"), "model", F.lit(OPERATIONAL_DESIGN).alias("forecast_design"),
        F.lit(start).alias("test_start"), F.lit(end).alias("test_end"),
        F.lit(True).alias("uses_actual_target_history_through_previous_day"),
        F.lit(False).alias("uses_actual_target_values_on_forecast_day"),
        F.lit(OPERATIONAL_NOTE).alias("interpretation"),
        "mae", "rmse", "mape",
    )


def compare_designs(
    operational: DataFrame, strict: DataFrame, benchmark: DataFrame | None = None, keys: Keys = ()
) -> DataFrame:
    """Operational, strict and benchmark metrics; the first source of a model and design wins."""
    columns = [*keys, "model", "forecast_design", "mae", "rmse", "mape"]
    tables = [t.select(*columns) for t in (operational, strict, benchmark) if t is not None]
    return keep_by_priority(stacked(*tables), [*keys, "model", "forecast_design"], last=False)


def place_of(column: str, values: list[str]) -> Column:
    """Position of a category in a fixed order."""
    return F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int")


def top_per_group(df: DataFrame, group: list[str], by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` largest rows of each group; the rank filter is pushed below the shuffle by the optimiser."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(by).desc(), tie))
    return df.withColumn("place", place).where(F.col("place") <= n)


def metrics_union(*tables: DataFrame) -> DataFrame:
    """Combined metric table in which a later table replaces the rows of an earlier one."""
    return keep_by_priority(stacked(*tables), ["model"])
