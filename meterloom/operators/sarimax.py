"""Seasonal ARIMA (1,1,1)(1,1,1) with weekly season, by two-stage regression over all series at once.

The regressions are grouped normal equations, so estimation is a few Spark aggregations however many
series there are. Coefficients therefore differ from exact likelihood estimates; forecasts are judged by
their error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.daily import align_to_calendar, densify, standardise
from meterloom.operators.folds import back, days_of, fold, pushed
from meterloom.operators.regression import least_squares, linear_value
from meterloom.operators.series import Keys, attach, by_series, join_series
from meterloom.session import cut_lineage

# Season length; the lags of the expanded (1,1,1)(1,1,1) polynomials.
SEASON = 7
TERMS = (1, 7, 8)

# Own choices: length of the first-stage autoregression, days of state kept for the forecast.
LONG_LAGS = 21
STATE_DAYS = 60
LARGEST_ROOT = 0.98

# Own choice: how a forecast came about, told on every row.
FITTED, SHRUNK, DIFFERENCES, LAST = "fitted", "fitted, lag weights shrunk", "seasonal differences only", "last value"


def differenced(value: Column, line) -> Column:
    """First difference of the seasonal difference."""
    return (
        value - F.lag(value, 1).over(line) - F.lag(value, SEASON).over(line) + F.lag(value, SEASON + 1).over(line)
    )


def steadied(weights: np.ndarray) -> np.ndarray:
    """Shrink lag weights until the recursion they define dies out."""
    order = max(TERMS)
    companion = np.zeros((order, order))
    companion[0, [k - 1 for k in TERMS]] = weights
    companion[1:, :-1] = np.eye(order - 1)
    radius = np.abs(np.linalg.eigvals(companion)).max()
    if radius <= LARGEST_ROOT:
        return weights
    return weights * np.array([(LARGEST_ROOT / radius) ** k for k in TERMS])


def estimate(train: DataFrame, target: str, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """Weights of past values and past shocks per series, and the training days with their shocks."""
    line = by_series(keys)
    days = train.select(*keys, "date", F.col(target).cast("double").alias("_y")).where("_y is not null")
    lagged = days.withColumn("_w", differenced(F.col("_y"), line)).withColumns(
        {f"_w{k}": F.lag("_w", k).over(line) for k in range(1, LONG_LAGS + 1)}
    )
    lagged = cut_lineage(lagged)
    long = [f"_w{k}" for k in range(1, LONG_LAGS + 1)]
    first = least_squares(lagged, "_w", long, keys)
    shocks = attach(lagged, first, keys).withColumn("_e", F.col("_w") - linear_value(long)).drop("coefficients")
    names = [f"_w{k}" for k in TERMS] + [f"_e{k}" for k in TERMS]
    second = least_squares(
        shocks.withColumns({f"_e{k}": F.lag("_e", k).over(line) for k in TERMS}), "_w", names, keys
    )
    return second, shocks.select(*keys, "date", "_y", "_w", "_e")


def weight_residuals(train: DataFrame, target: str, keys: Keys = ()) -> DataFrame:
    """How far estimated weights are from least squares, per series and term.

    What a regression leaves is orthogonal to each of its inputs; the sum of their products is given relative to the sum of
    its terms. Needs no other fit.
    """
    model, days = estimate(train, target, keys)
    line = by_series(keys)
    names = [f"_w{k}" for k in TERMS] + [f"_e{k}" for k in TERMS]
    lagged = days.withColumns({f"_{c}{k}": F.lag(f"_{c}", k).over(line) for c in "we" for k in TERMS}).na.drop(subset=["_w", *names])
    rest = F.col("_w") - linear_value(names)
    sums = attach(lagged, model, keys).groupBy(*keys).agg(
        *[F.sum(F.col(c) * rest).alias(f"_r_{c}") for c in names], *[F.sum(F.abs(F.col(c) * rest)).alias(f"_a_{c}") for c in names])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c[1:]).alias("term"), (F.abs(F.col(f"_r_{c}")) / (F.col(f"_a_{c}") + 1.0)).alias("distance")) for c in names])).alias("_e")
    return sums.select(*keys, cells).select(*keys, "_e.*")


def forecast_days(series: DataFrame) -> DataFrame:
    """Add ``_made``, a forecast for each entry of ``_days``, to one row per series.

    Needs the last values ``_y``, differences ``_w`` and shocks ``_e`` as arrays and weights ``_ar`` and ``_ma`` at the
    lags ``TERMS``. Shocks to come are zero; each step undoes both differences.
    """
    def step(s: Column, _: Column) -> dict[str, Column]:
        move = sum((F.col("_ar")[i] * F.coalesce(back(s["w"], k), F.lit(0.0)) + F.col("_ma")[i] * F.coalesce(back(s["e"], k), F.lit(0.0))
                    for i, k in enumerate(TERMS)), F.lit(0.0))
        value = move + back(s["y"], 1) + back(s["y"], SEASON) - back(s["y"], SEASON + 1)
        return {"y": pushed(s["y"], value, SEASON + 1), "w": pushed(s["w"], move, max(TERMS)),
                "e": pushed(s["e"], F.lit(0.0), max(TERMS)), "made": pushed(s["made"], value)}

    types = dict.fromkeys(("y", "w", "e", "made"), "array<double>")
    start = {"y": F.col("_y"), "w": F.col("_w"), "e": F.col("_e"), "made": F.array()}
    return series.withColumn("_made", fold(F.col("_days"), start, types, step)["made"])


def given_shocks(moves: Column, ar: Column, ma: Column) -> Column:
    """Shocks of an array of differenced values under given weights, starting from rest. A null difference is no step's
    value: it counts as zero, and its shock too."""
    def step(s: Column, move: Column) -> dict[str, Column]:
        expected = sum((ar[i] * F.coalesce(back(s["w"], k), F.lit(0.0)) + ma[i] * F.coalesce(back(s["e"], k), F.lit(0.0))
                        for i, k in enumerate(TERMS)), F.lit(0.0))
        shock = F.coalesce(move - expected, F.lit(0.0))
        return {"w": pushed(s["w"], F.coalesce(move, F.lit(0.0)), max(TERMS)), "e": pushed(s["e"], shock, max(TERMS)), "all": pushed(s["all"], shock)}

    types = dict.fromkeys(("w", "e", "all"), "array<double>")
    return fold(moves, dict.fromkeys(types, F.array()), types, step)["all"]


def _panel(past: DataFrame, test: DataFrame, target: str, keys: Keys) -> DataFrame:
    """One row per series with its test days, and its training days as arrays ``_y``, ``_w`` and ``_e``."""
    ahead = test.select(*keys, "date", F.col(target).cast("double").alias("actual")).where("actual is not null")
    of = lambda c: F.transform("_past", lambda d: F.coalesce(d[c], F.lit(0.0))).alias(c)
    known = days_of(past, keys, ["_y", "_w", "_e"], "_past").select(*keys, of("_y"), of("_w"), of("_e"))
    return attach(days_of(ahead, keys, ["actual"]), known, keys)


def _rows(series: DataFrame, keys: Keys, forecast: Column, name: str, *more: str) -> DataFrame:
    day = F.posexplode("_days").alias("_at", "_day")
    rows = series.select(*keys, "_made", *[c for c in ("_known",) if c in series.columns], *more, day)
    return rows.select(*keys, "_day.date", "_day.actual", forecast.alias(name), *more)


def sarima(
    train: DataFrame, test: DataFrame, target: str, keys: Keys = (), name: str = "sarima_forecast"
) -> DataFrame:
    """Forecast every test day from the last training days of its series.

    Steps count known days, so a missing day is no step, neither in training nor ahead. ``sarima_status`` says how:
    fitted; fitted with lag weights shrunk because their recursion would not die out; seasonal differences only,
    where a series has fewer rows than weights; or the last value, where it is shorter than a season.
    """
    keys = list(keys)

    @F.pandas_udf("array<double>")
    def calm(weights: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else steadied(np.nan_to_num(np.asarray(w, float)[: len(TERMS)])) for w in weights])

    model, days = estimate(train, target, keys)
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    state = days.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= STATE_DAYS).drop("_back")
    raw = F.transform("coefficients", lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    zeros = F.array(*[F.lit(0.0)] * len(TERMS))
    weights = cut_lineage(model.select(*keys, raw.alias("_raw"), calm("coefficients").alias("_calm")))
    series = attach(_panel(state, test, target, keys), weights, keys)
    series = series.withColumns({
        "_known": F.coalesce(F.size("_y"), F.lit(0)), "_ar": F.coalesce("_calm", zeros),
        "_ma": F.coalesce(F.slice("_raw", len(TERMS) + 1, len(TERMS)), zeros)})
    shrunk = F.slice("_raw", 1, len(TERMS)) != F.col("_calm")
    status = F.when(F.col("_known") <= SEASON, LAST).when(F.col("_raw").isNull(), DIFFERENCES).when(shrunk, SHRUNK).otherwise(FITTED)
    made = forecast_days(series.withColumn("sarima_status", status).withColumn("_last", back(F.col("_y"), 1)))
    value = F.when(F.col("_known") > SEASON, F.get("_made", F.col("_at"))).otherwise(F.col("_last"))
    return _rows(made, keys, value, name, "sarima_status", "_last").drop("_last")


def sarima_given(
    train: DataFrame, test: DataFrame, target: str, ar: Sequence[float], ma: Sequence[float], keys: Keys = (), name: str = "sarima_forecast",
) -> DataFrame:
    """Forecasts under given weights of past values and past shocks at the lags ``TERMS``; null for series of less than
    eight known days. Shocks are those that the weights themselves leave, from the first training day on."""
    known = train.select(*keys, "date", F.col(target).cast("double").alias("_y")).where("_y is not null")
    moves = known.withColumn("_w", differenced(F.col("_y"), by_series(keys))).withColumn("_e", F.lit(0.0))
    series = _panel(moves, test, target, keys).withColumns({"_ar": F.array(*map(F.lit, ar)), "_ma": F.array(*map(F.lit, ma))})
    # The first differences need eight days before them and are no moves of the series.
    real = F.slice("_w", SEASON + 2, F.greatest(F.size("_w") - SEASON - 1, F.lit(0)))
    series = cut_lineage(series.withColumn("_w", real)).withColumn("_e", given_shocks(F.col("_w"), F.col("_ar"), F.col("_ma")))
    return _rows(forecast_days(series), keys, F.get("_made", F.col("_at")), name)


def sarimax(
    train: DataFrame, test: DataFrame, target: str, regressors: list[str], keys: Keys = ()
) -> DataFrame:
    """The same model on what outside influences leave unexplained; without regressors it is plain SARIMA.

    Regressors are aligned to the calendar, gap-filled and scaled by training statistics. Their weights
    come from the equally differenced regression; a series with fewer rows than regressors goes without.
    """
    if not regressors:
        return sarima(train, test, target, keys, "sarimax_forecast")
    keys = list(keys)
    both = train.unionByName(test, allowMissingColumns=True)
    days = densify(both.select(*keys, "date", F.col(target).cast("double").alias("_y")), keys)
    numeric = both.select(*keys, "date", *[
        (F.col(c).cast("int") if dict(both.dtypes)[c] == "boolean" else F.col(c)).alias(c) for c in regressors
    ])
    aligned = align_to_calendar(days, numeric, regressors, keys)
    ends = train.groupBy(*keys).agg(F.max("date").alias("_end"))
    marked = cut_lineage(attach(aligned, ends, keys).withColumn("_past", F.col("date") <= F.col("_end")))
    observed = marked.where(F.col("_y").isNotNull())
    scaled = standardise(observed, observed.where("_past"), regressors, keys)
    line = by_series(keys)
    moves = scaled.where("_past").withColumns({
        f"_d_{c}": differenced(F.col(c), line) for c in ["_y", *regressors]
    })
    weights = least_squares(moves, "_d__y", [f"_d_{c}" for c in regressors], keys)
    explained = cut_lineage(
        attach(scaled, weights, keys)
        .withColumn("_part", F.coalesce(linear_value(regressors), F.lit(0.0)))
        .withColumn("_rest", F.col("_y") - F.col("_part"))
        .select(*keys, "date", "_past", "_part", "_rest", "_y")
    )
    rest = sarima(
        explained.where("_past"), explained.where(~F.col("_past")),
        "_rest", keys, "_rest_forecast",
    )
    parts = explained.select(*keys, "date", "_part", F.col("_y").alias("actual"))
    return join_series(rest.select(*keys, "date", "_rest_forecast", "sarima_status"), parts, keys, ["date"], "inner").select(
        *keys, "date", "actual", (F.col("_rest_forecast") + F.col("_part")).alias("sarimax_forecast"), "sarima_status"
    )
