"""Exponential smoothing forecasts, with parameters chosen from a grid by one-step squared error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.daily import densify
from meterloom.operators.folds import chunks, days_of, fold, let, mean, pushed
from meterloom.operators.series import Keys, attach, spread
from meterloom.session import cut_lineage

# Season length and the shortest series for a seasonal fit.
SEASON = 365
SEASONAL_ROWS = 730

# Own choice: the shortest series for a trend, whose start compares two stretches of this many days.
TREND_ROWS = 10
# Own choice: names of the forms, richest first; every forecast tells which one it comes from.
FORMS = ["trend and season", "trend", "level", "last value"]

# Own choice: the parameter grid.
LEVEL_WEIGHTS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
TREND_WEIGHTS = (0.001, 0.01, 0.1)
SEASON_WEIGHTS = (0.02, 0.1, 0.3)


# What a fold over the days carries along: the seasonal states as a queue, the next day's first.
TURN = 20
STATE = {"level": "double", "drift": "double", "wave": "array<double>", "squared": "double"}


def starts(days: Column, trend: bool, season: int | None) -> dict[str, Column]:
    """First state: means of the first two cycles (or stretches) give level, trend and seasonal states."""
    length = season or TREND_ROWS
    first, second = mean(F.slice(days, 1, length)), mean(F.slice(days, length + 1, length))
    level = first if season else F.get(F.filter(days, lambda v: v.isNotNull()), F.lit(0))
    drift = F.coalesce((second - first) / length, F.lit(0.0)) if trend else F.lit(0.0)
    # A day missing from the first cycle has no seasonal state yet; a cycle is full, or this form isn't tried.
    wave = F.transform(F.slice(days, 1, season), lambda v: F.coalesce(v - first, F.lit(0.0))) if season else F.array(F.lit(0.0))
    return {"level": level, "drift": drift, "wave": wave, "squared": F.lit(0.0)}


def smoothed(days: Column, weights: tuple[Column, Column, Column], trend: bool, season: int | None) -> Column:
    """State after all days of an array under weights of level, trend and season, with its squared one-step errors.

    A missing day (null) moves the state by its own prediction. The queue of seasonal states is turned once per
    ``TURN`` days: a fold over these days meets each of them next to its seasonal state.
    """
    alpha, beta, gamma = weights

    def step(s: Column, day: Column) -> Column:
        error = F.coalesce(day["value"] - (s["level"] + s["drift"]) - day["wave"], F.lit(0.0))
        return let(error, lambda e: F.struct(
            (s["level"] + s["drift"] + alpha * e).alias("level"), (s["drift"] + beta * alpha * e if trend else s["drift"]).alias("drift"),
            (pushed(s["wave"], day["wave"] + gamma * (1 - alpha) * e) if season else s["wave"]).alias("wave"),
            (s["squared"] + e * e).alias("squared")))

    def turn(s: Column, part: Column) -> Column:
        paired = F.zip_with(part, F.slice(s["wave"], 1, F.size(part)), lambda v, w: F.struct(v.alias("value"), w.alias("wave")))
        begun = {name: s[name] for name in STATE} | {"wave": F.array()}
        return let(fold(paired, begun, STATE, step), lambda r: F.struct(
            r["level"].alias("level"), r["drift"].alias("drift"),
            F.concat(F.slice(s["wave"], F.size(part) + 1, season), r["wave"]).alias("wave"), r["squared"].alias("squared")))

    start = starts(days, trend, season)
    if season:
        return fold(chunks(days, min(TURN, season)), start, STATE, turn)
    return fold(F.transform(days, lambda v: F.struct(v.alias("value"), F.lit(0.0).alias("wave"))), start, STATE, step)


def ahead_value(state: Column, steps: Column) -> Column:
    """Forecast ``steps`` days after the last one."""
    return state["level"] + state["drift"] * steps + F.get(state["wave"], (steps - 1) % F.size(state["wave"]))


def forms(rows: Column) -> Column:
    """Rows of the grid to try for a series of so many days: place of the form and its weights."""
    def grid(form: int, least: int, trend_weights, season_weights) -> list[Column]:
        cells = [(a, b, g) for a in LEVEL_WEIGHTS for b in trend_weights for g in season_weights]
        return [F.when(rows >= least, F.struct(
            F.lit(form).alias("form"), F.lit(i).alias("place"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")))
            for i, (a, b, g) in enumerate(cells)]

    return F.array_compact(F.array(
        *grid(0, SEASONAL_ROWS, TREND_WEIGHTS, SEASON_WEIGHTS), *grid(1, TREND_ROWS, TREND_WEIGHTS, (0.0,)), *grid(2, 1, (0.0,), (0.0,))))


def _packed(train: DataFrame, target: str, keys: Keys) -> DataFrame:
    """One row per series: ``_values`` of all calendar days in order, and the last day ``_end``."""
    dense = densify(train.select(*keys, "date", F.col(target).cast("double").alias("_y")), keys)
    return days_of(dense, keys, ["_y"]).select(
        *keys, F.transform("_days", lambda d: d["_y"]).alias("_values"), F.element_at("_days", -1)["date"].alias("_end"))


def _ahead(test: DataFrame, target: str, state: DataFrame, keys: Keys) -> DataFrame:
    """Test days with the state of their series and ``_steps``, days since its last training day."""
    days = test.select(*keys, "date", F.col(target).cast("double").alias("actual"))
    return attach(days, state, keys).withColumn("_steps", F.datediff("date", "_end"))


def holt_winters(
    train: DataFrame, test: DataFrame, target: str, keys: Keys = ()
) -> DataFrame:
    """Forecast each test day from a series' training days; forms that fail give way to simpler ones.

    One series is one row with an array of its calendar days; every form and weight to try is a row of its own,
    dealt over the tasks, and the smallest squared error of the richest usable form picks the forecast.
    ``holt_winters_form`` names the form: trend and season from two years on, a trend from ten days on, else the level;
    the last value where no form gives numbers.
    """
    keys = list(keys)
    packed = cut_lineage(_packed(train, target, keys))
    tried = spread(packed.select(*keys, "_values", F.explode(forms(F.size("_values"))).alias("_try")), ["_try"])
    weights = (F.col("_try.alpha"), F.col("_try.beta"), F.col("_try.gamma"))
    rank = F.col("_try.form")
    state = F.when(rank == 0, smoothed(F.col("_values"), weights, True, SEASON)).when(
        rank == 1, smoothed(F.col("_values"), weights, True, None)).otherwise(smoothed(F.col("_values"), weights, False, None))
    run = tried.select(*keys, "_try", state.alias("_state"))
    usable = run.where("_state.level IS NOT NULL AND NOT isnan(_state.squared) AND abs(_state.squared) < double('Infinity')")
    best = usable.groupBy(*keys).agg(F.min_by(
        F.struct("_state", rank.alias("form")), F.struct(rank, F.col("_state.squared").alias("squared"), F.col("_try.place").alias("place"))).alias("_best"))
    known = F.element_at(F.filter("_values", lambda v: v.isNotNull()), -1)
    series = packed.select(*keys, "_end", F.when(F.exists("_values", lambda v: v.isNotNull()), known).alias("_last"))
    days = _ahead(test, target, attach(series, best, keys), keys)
    names = F.array(*map(F.lit, FORMS))
    return days.select(
        *keys, "date", "actual", F.coalesce(ahead_value(F.col("_best")["_state"], F.col("_steps")), "_last").alias("holt_winters_forecast"),
        F.coalesce(F.get(names, F.col("_best")["form"]), F.lit(FORMS[-1])).alias("holt_winters_form"))


def smoothed_forecast(
    train: DataFrame, test: DataFrame, target: str, weights: tuple[float, float, float], keys: Keys = (), season: int = SEASON,
) -> DataFrame:
    """Forecasts of smoothing with trend and season under given weights of level, trend and season.

    Null for series of less than two seasons, or without a value in the first one.
    """
    packed = _packed(train, target, keys).where(F.size("_values") >= 2 * season)
    state = packed.select(*keys, "_end", smoothed(F.col("_values"), tuple(map(F.lit, weights)), True, season).alias("_state"))
    days = _ahead(test, target, cut_lineage(state), keys)
    return days.select(*keys, "date", "actual", ahead_value(F.col("_state"), F.col("_steps")).alias("holt_winters_forecast"))


def level_smoothing(train: DataFrame, target: str, weight: float, keys: Keys = ()) -> DataFrame:
    """Final level of simple smoothing with a given weight, entirely in expressions."""
    ordered = F.array_sort(F.collect_list(F.struct("date", F.col(target).cast("double").alias("y"))))
    packed = train.where(F.col(target).isNotNull()).groupBy(*keys).agg(ordered.alias("_days"))
    level = F.aggregate(
        F.slice("_days", 2, F.size("_days")),
        F.get("_days", F.lit(0))["y"],
        lambda held, day: held + F.lit(float(weight)) * (day["y"] - held),
    )
    return packed.select(*keys, level.alias("level"))
