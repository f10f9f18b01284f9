"""Strict multi-step evaluation: forecasts feed the lag and rolling inputs of later days.

A series is one row that holds its history and what is known of its test days. The linear model runs as one fold in
the JVM. Tree models forecast many days of all series at once with the fitted model's own ``transform``, from a guess of
the days before, and again from these forecasts, until no forecast changes any more. A day only needs earlier days, so
what comes out is what a run day by day gives, in far fewer steps.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators import features
from meterloom.operators.daily import coerce_numeric
from meterloom.operators.folds import back, days_of, fold, last, mean, pushed
from meterloom.operators.learn import SERIES_CODE, Fitted, fit_models, is_history, side_by_side
from meterloom.operators.quantiles import union_all
from meterloom.operators.series import Keys, attach
from meterloom.session import cut_lineage

#: Days back that lags and windows reach.
REACH = max(*features.LAGS, *[length for _, length, _ in features.ROLLING.values()])

# Own choice: days of a series that tree models forecast in one round, from the first one not yet settled.
DAYS_A_ROUND = 400


def next_inputs(history: Column, known: Column, fill: Column, columns: list[str]) -> list[Column]:
    """Inputs of the day after ``history``: its lags and windows, else the known value, else the training median."""
    lags = {f"lag_{k}": back(history, k) for k in features.LAGS}

    def rolled(statistic: str, length: int, fewest: int) -> Column:
        part = last(history, length)
        return F.when(F.size(part) >= fewest, F.array_max(part) if statistic == "max" else mean(part))

    made = {**lags, **{name: rolled(*rule) for name, rule in features.ROLLING.items()}}
    return [F.coalesce(made.get(c, known[i]), fill[i]) for i, c in enumerate(columns)]


def linear_recursion(state: DataFrame, columns: list[str], weights: str = "_weights") -> DataFrame:
    """Add ``_made``, the forecasts of all days of a series by a linear model, as one fold.

    ``state`` holds per series ``_history`` (training values in order), ``_days`` (test days with their ``known``
    inputs), ``_fill`` (a value per input for missing ones) and ``weights`` (intercept first).
    """
    w = F.col(weights)

    def step(s: Column, day: Column) -> dict[str, Column]:
        inputs = next_inputs(s["history"], day["known"], F.col("_fill"), columns)
        value = sum((w[i + 1] * x for i, x in enumerate(inputs)), w[0])
        return {"history": pushed(s["history"], value, REACH), "made": pushed(s["made"], value)}

    types = {"history": "array<double>", "made": "array<double>"}
    start = {"history": F.col("_history"), "made": F.array().cast("array<double>")}
    return state.withColumn("_made", fold(F.col("_days"), start, types, step)["made"])


def tree_recursion(state: DataFrame, columns: list[str], model, keys: Keys = ()) -> DataFrame:
    """``state`` with ``_made``, the forecasts of all days of a series by a tree model.

    ``state`` also holds ``_mu``, ``_sd`` and the code of each series, in whose units the model was fitted, or none of
    them. ``_made`` starts as a guess. A round forecasts the next ``DAYS_A_ROUND`` days after the ``_at`` settled ones from
    what ``_made`` says of the days before. The first forecast that differs from ``_made``, and all before it, came from
    settled days only, so these are settled too: every round settles a day at least, and most settle many.
    """
    units = "_mu" in state.columns
    names = [*keys, "_fill", *(["_mu", "_sd", SERIES_CODE] if units else [])]
    inputs = next_inputs(F.col("_day")["past"], F.col("_day")["known"], F.col("_fill"), columns)
    value = F.col("_p")
    if units:
        inputs = [(x - F.col("_mu")) / F.col("_sd") if is_history(c) else x for x, c in zip(inputs, columns, strict=True)]
        inputs.append(F.col(SERIES_CODE))
        value = value * F.col("_sd") + F.col("_mu")
    vector = array_to_vector(F.array(*inputs)).alias("_x")
    at, made = F.col("_at"), F.col("_made")

    def day(i: Column) -> Column:
        before = F.size("_history") + i
        past = F.slice(F.concat("_history", made), F.greatest(before - REACH, F.lit(0)) + 1, F.least(before, F.lit(REACH)))
        return F.struct(i.alias("at"), past.alias("past"), F.get("_days", i)["known"].alias("known"))

    ahead = F.explode(F.transform(F.sequence(at, F.least(at + DAYS_A_ROUND, F.size(made)) - 1), day)).alias("_day")
    old, new = F.slice(made, at + 1, F.size("_new")), F.transform("_new", lambda r: r["value"])
    changed = F.array_position(F.zip_with(old, new, lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
    settled = F.when(changed == 0, at + F.size("_new")).when(changed > 0, at + changed).otherwise(at)
    mixed = F.when(F.col("_new").isNull(), made).otherwise(
        F.concat(F.slice(made, F.lit(1), at), new, F.slice(made, at + F.size("_new") + 1, F.size(made))))
    model.setFeaturesCol("_x").setPredictionCol("_p")
    table = cut_lineage(state.select(*keys, F.lit(0).alias("_at"), F.array_repeat(mean(last(F.col("_history"), 30)), F.size("_days")).alias("_made")))
    while not table.where(at < F.size(made)).isEmpty():
        rows = attach(state, table, keys).where(at < F.size(made)).select(*names, ahead).select(*names, "_day.at", vector)
        scored = model.transform(rows).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", value.alias("value")))).alias("_new"))
        table = cut_lineage(attach(table, scored, keys).select(*keys, settled.alias("_at"), mixed.alias("_made")))
    model.setFeaturesCol("features").setPredictionCol("prediction")
    return attach(state, table, keys).drop("_at")


def series_state(rows: DataFrame, target: str, start: str, columns: list[str], keys: Keys = ()) -> DataFrame:
    """One row per series: ``_history``, ``_days`` and ``_fill`` of a table of training and test days.

    History are the last complete training rows. Series without one, or without a test day, have nothing to do.
    """
    first = F.lit(start).cast("date")
    train = rows.where(F.col("date") < first).na.drop(subset=[target, *columns])
    test = rows.where(F.col("date") >= first)
    for side, part in (("training", train), ("test", test)):
        if part.isEmpty():
            raise ValueError(f"the {side} period holds no usable rows")
    fill = train.groupBy(*keys).agg(F.array(*[F.percentile(c, F.lit(0.5)) for c in columns]).alias("_fill"))
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    tail = train.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= REACH)
    past = days_of(tail, keys, [target], "_past").select(*keys, F.transform("_past", lambda d: d[target]).alias("_history"))
    ahead = days_of(test.withColumn("known", F.array(*columns)).withColumn("actual", F.col(target)), keys, ["known", "actual", "demand_regime"])
    return attach(attach(ahead, past, keys), fill, keys).where(F.col("_history").isNotNull())


def forecast_rows(state: DataFrame, model: str, keys: Keys = ()) -> DataFrame:
    """One row per series and test day from folded series."""
    day = F.posexplode("_days").alias("_at", "_day")
    return state.select(*keys, "_made", day).select(
        *keys, "_day.date", F.lit(model).alias("model"), "_day.actual", "_day.demand_regime", F.get("_made", F.col("_at")).alias("forecast"))


def panel_rows(daily: DataFrame, target: str, start: str, end: str, keys: Keys = (), exogenous: str = "drop") -> tuple[DataFrame, list[str]]:
    """Stored days up to ``end`` with the inputs that a strict run may use, as numbers, and their names."""
    frame = features.feature_frame(daily, target, start, keys)
    columns = features.strict_columns(features.feature_columns(frame, target), exogenous)
    flags = [f.name for f in frame.schema if f.name in columns and f.dataType.simpleString() == "boolean"]
    numeric = coerce_numeric(frame, [c for c in columns if c not in flags]).withColumns(
        {c: F.col(c).cast("int").cast("double") for c in flags}
    )
    return cut_lineage(numeric.where(F.col("date") <= F.lit(end).cast("date")).select(
        *keys, "date", F.col(target).cast("double").alias(target), "demand_regime", *columns
    )), columns


def strict_recursive(
    daily: DataFrame, target: str, start: str, end: str, keys: Keys = (), exogenous: str = "drop",
    models: list[str] | None = None, settings: dict[str, dict] | None = None, fitted: Fitted | None = None,
) -> tuple[DataFrame, Fitted]:
    """Forecast the whole test period without looking at its target values.

    Models are fitted by Spark on complete training rows, unless ``fitted`` brings ones with the same inputs. Each
    series starts from its last training values; missing inputs take the training median.
    """
    keys = list(keys)
    rows, columns = panel_rows(daily, target, start, end, keys, exogenous)
    state = cut_lineage(series_state(rows, target, start, columns, keys))
    if fitted is None:
        train = rows.where(F.col("date") < F.lit(start).cast("date")).na.drop(subset=[target, *columns])
        fitted = fit_models(train, target, columns, keys, models, settings)
    elif fitted.columns != columns:
        raise ValueError(f"the models have other inputs: {fitted.columns}")
    made = []
    if fitted.ridge is not None:
        weights = fitted.ridge.select(*keys, F.concat(F.array("intercept"), F.col("coefficients")).alias("_weights"))
        made.append(forecast_rows(linear_recursion(attach(state, weights, keys), columns), "ridge", keys))
    if fitted.trees:
        placed = state if fitted.scales is None else cut_lineage(attach(state, fitted.scales.select(*keys, "_mu", "_sd", SERIES_CODE), keys))
        runs = side_by_side([lambda model=model: tree_recursion(placed, columns, model, keys) for model in fitted.trees.values()], state.sparkSession)
        made += [forecast_rows(df, name, keys) for name, df in zip(fitted.trees, runs, strict=True)]
    return union_all(made), fitted
