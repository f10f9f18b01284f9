"""Stress scenarios on a base forecast, residual bootstrap and capacity pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.clock import add_calendar
from meterloom.functions.names import RENEWABLE_COLUMNS
from meterloom.operators.quantiles import interpolated
from meterloom.operators.series import Keys, attach, join_series, spread
from meterloom.sources.tables import require_columns, required

# Scenarios in order, uplifts, the cap on their sum, and the text describing each.
SCENARIOS = ["baseline", "high_demand_stress", "low_renewable_stress", "winter_peak_stress", "combined_stress"]
HIGH_DEMAND_UPLIFT = 0.05
LOW_RENEWABLE_UPLIFT = 0.02
WINTER_PEAK_UPLIFT = 0.07
COMBINED_CAP = 0.12
ASSUMPTIONS = {
    "baseline": "No systematic uplift; uncertainty comes from empirical forecast residuals.",
    "high_demand_stress": "Applies a 5% uplift on high-demand or peak-season days.",
    "low_renewable_stress": "Applies a 2% uplift on low embedded wind/solar proxy days; this is a "
    "simplified stress proxy, not a physical grid model.",
    "winter_peak_stress": "Applies a 7% uplift on winter or peak-season days.",
    "combined_stress": "Combines high-demand, low-renewable and winter stress assumptions with total "
    "uplift capped at {cap:.0%}.",
}
THRESHOLD_SOURCE = "95th percentile of training-period actual demand"
SUPPLIED_SOURCE = "user-supplied CLI value"
DESIGN_CAVEAT = (
    "Scenario results inherit the one-day-ahead forecast design unless a strict recursive baseline is substituted."
)


def choose_base(forecasts: DataFrame, column: str) -> DataFrame:
    """Use one forecast column as ``base_forecast``; it must be there and be a number on every row."""
    if column not in forecasts.columns:
        offered = [c for c in forecasts.columns if c.endswith("_forecast")]
        raise KeyError(f"base forecast {column} is not available; available forecasts: {offered}")
    value = required(F.col(column).try_cast("double"), f"base forecast {column} has missing or non-numeric values")
    return forecasts.withColumn("base_forecast", value)


def add_context(
    forecasts: DataFrame, daily: DataFrame, target: str, start: str, end: str, keys: Keys = ()
) -> DataFrame:
    """Calendar, renewable and regime context of each forecast day; clashing names get ``_daily``."""
    window = daily.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    calendar = ["month", "day_of_week", "is_weekend", "is_winter", "is_peak_season"]
    described = add_calendar(window.drop(*calendar), only=calendar)
    wanted = [c for c in [target, *calendar, *RENEWABLE_COLUMNS, "demand_regime"] if c in described.columns]
    context = described.select(
        *keys, "date", *[F.col(c).alias(f"{c}_daily" if c in forecasts.columns else c) for c in wanted]
    )
    joined = join_series(forecasts, context, keys, ["date"])
    if "actual" not in joined.columns:
        joined = joined.withColumn("actual", F.col(target))
    return joined


def residual_pool(
    context: DataFrame, keys: Keys = (), pool: str = "test", train: DataFrame | None = None
) -> DataFrame:
    """Centred residuals of the base forecast, numbered from 0 by day within each series.

    ``pool="test"`` takes the evaluated days of ``context``, which is optimistic; ``pool="train"`` takes the rows
    of ``train``, base forecasts of training days with their actuals.
    """
    if pool not in ("test", "train"):
        raise ValueError("pool must be test or train")
    if pool == "train":
        if train is None:
            raise ValueError("pool=train needs base forecasts of training days")
        context = train
    require_columns(context, "actual", "base_forecast")
    error = F.col("actual").try_cast("double") - F.col("base_forecast")
    known = context.select(*keys, "date", error.alias("_e")).where("_e is not null")
    series = Window.partitionBy(*keys)
    return known.select(
        *keys,
        (F.row_number().over(series.orderBy("date")) - 1).alias("idx"),
        "date",
        (F.col("_e") - F.avg("_e").over(series)).alias("residual"),
    )


def capacity_threshold(
    daily: DataFrame, target: str, start: str, keys: Keys = (), supplied: float | None = None, share: float = 0.95
) -> DataFrame:
    """Threshold with its documentation: a training quantile, or the value supplied by the user."""
    train = daily.where((F.col("date") < F.lit(start).cast("date")) & F.col(target).isNotNull())
    if supplied is not None:
        return train.groupBy(*keys).agg(F.lit(target).alias("target")).select(
            *keys, "target", F.lit(float(supplied)).alias("capacity_threshold"),
            F.lit(SUPPLIED_SOURCE).alias("threshold_source"),
            F.lit(None).cast("date").alias("training_start"), F.lit(None).cast("date").alias("training_end"),
            F.lit(None).cast("long").alias("training_rows"), F.lit(None).cast("double").alias("percentile"),
        )
    return train.groupBy(*keys).agg(
        F.lit(target).alias("target"),
        F.percentile(target, F.lit(share)).alias("capacity_threshold"),
        F.lit(THRESHOLD_SOURCE).alias("threshold_source"),
        F.min("date").alias("training_start"), F.max("date").alias("training_end"),
        F.count(F.lit(1)).alias("training_rows"), F.lit(share).alias("percentile"),
    )


def renewable_total(columns: list[str]) -> Column:
    """Sum of the known parts; null only when all are null."""
    known = F.greatest(*[F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))
    return F.when(known == 1, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)))


def add_low_renewable(
    context: DataFrame, daily: DataFrame, start: str, keys: Keys = ()
) -> DataFrame:
    """Flag days at or below the first training quartile of wind plus solar; false without those columns."""
    columns = [c for c in RENEWABLE_COLUMNS if c in daily.columns and c in context.columns]
    if not columns:
        return context.withColumn("low_renewable", F.lit(False))
    train = daily.where(F.col("date") < F.lit(start).cast("date"))
    cut = train.select(*keys, renewable_total(columns).alias("_r")).groupBy(*keys).agg(
        F.percentile("_r", F.lit(0.25)).alias("_cut")
    )
    flagged = attach(context, cut, keys).withColumn(
        "low_renewable", F.coalesce(renewable_total(columns) <= F.col("_cut"), F.lit(False))
    )
    return flagged.drop("_cut")


def scenario_rows(
    context: DataFrame,
    daily: DataFrame,
    start: str,
    keys: Keys = (),
    high_demand: float = HIGH_DEMAND_UPLIFT,
    low_renewable: float = LOW_RENEWABLE_UPLIFT,
    winter_peak: float = WINTER_PEAK_UPLIFT,
    cap: float = COMBINED_CAP,
) -> DataFrame:
    """Every forecast day under every scenario, with uplift and adjusted forecast."""
    flagged = add_low_renewable(context, daily, start, keys)
    flagged = add_calendar(flagged, only=["is_winter", "is_peak_season"])
    season = F.col("is_peak_season")
    high = F.lit(False)
    if "demand_regime" in context.columns:
        high = F.coalesce(F.col("demand_regime") == "high", F.lit(False))
    uplift = lambda rule, size: F.when(rule, F.lit(float(size))).otherwise(F.lit(0.0))
    parts = [
        uplift(high | season, high_demand),
        uplift(F.col("low_renewable"), low_renewable),
        uplift(F.col("is_winter") | season, winter_peak),
    ]
    uplifts = [F.lit(0.0), *parts, F.least(parts[0] + parts[1] + parts[2], F.lit(float(cap)))]
    options = F.array(*[
        F.struct(
            F.lit(name).alias("scenario"), value.alias("scenario_uplift_pct"),
            F.lit(ASSUMPTIONS[name].format(cap=cap)).alias("scenario_assumption"),
        )
        for name, value in zip(SCENARIOS, uplifts)
    ])
    return (
        flagged.withColumn("_s", F.explode(options))
        .select(*flagged.columns, "_s.*")
        .withColumn("adjusted_forecast", F.col("base_forecast") * (1 + F.col("scenario_uplift_pct")))
    )


def pooled(pool: DataFrame, keys: Keys = ()) -> DataFrame:
    """Residuals of each series as one array in day order; a series has one residual per evaluated day."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "residual")))
    return pool.groupBy(*keys).agg(F.transform(ordered, lambda r: r["residual"]).alias("_pool"))


def draw_index(seed: int, parts: list[Column], draw: Column, size: Column) -> Column:
    """Pool index of one draw, from a hash of seed, series, scenario, day and draw number.

    The draw depends on nothing but its own name, so neither row order nor task layout nor a retried
    task can change it.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts, draw.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), size.cast("long"))


def bootstrap(
    scenarios: DataFrame,
    pool: DataFrame,
    thresholds: DataFrame | None = None,
    draws: int = 1000,
    seed: int = 42,
    keys: Keys = (),
    salts: int = 16,
) -> DataFrame:
    """Simulated range and exceedance probability of every scenario day.

    Bare scenario rows are dealt out first, a series over ``salts`` parts; the pool of a series, one short array, is
    copied to those parts and meets the rows there, so it never travels with each of them. Draws live in an
    array on their scenario-day row: work grows with rows x draws and memory with the draws of one row.
    """
    if draws <= 0:
        raise ValueError("the number of draws must be positive")
    size = F.size("_pool")
    names = [*[F.col(k).cast("string") for k in keys], F.col("scenario"), F.date_format("date", "yyyy-MM-dd")]
    bare = scenarios
    if thresholds is not None and "capacity_threshold" not in scenarios.columns:
        bare = attach(bare, thresholds.select(*keys, "capacity_threshold"), keys)
    elif thresholds is None:
        bare = bare.withColumn("capacity_threshold", F.lit(None).cast("double"))
    salted = spread(bare.withColumn("_salt", F.pmod(F.xxhash64("date", "scenario"), F.lit(salts)).cast("int")), [*keys, "_salt"])
    copies = pooled(pool, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    drawn = join_series(salted, copies, keys, ["_salt"]).withColumn("_pool", required(
        F.when(size > 0, F.col("_pool")), "no residuals are available to simulate from"
    )).withColumn("_sim", F.sort_array(F.transform(
        F.sequence(F.lit(0), F.lit(draws - 1)),
        lambda i: F.col("adjusted_forecast") + F.get("_pool", draw_index(seed, names, i, size).cast("int")),
    )))
    # Summed as decimals, which no order changes; the tenth decimal of a draw carries nothing.
    total = F.aggregate("_sim", F.lit(0).cast("decimal(30,9)"), lambda a, x: (a + x.cast("decimal(28,9)")).cast("decimal(30,9)"))
    exceeding = F.size(F.filter("_sim", lambda x: x > F.col("capacity_threshold"))) / draws
    return drawn.select(
        *keys, "date", "scenario", "base_forecast", "scenario_uplift_pct",
        (total.cast("double") / draws).alias("simulated_mean"),
        interpolated("_sim", 0.05).alias("simulated_p05"),
        interpolated("_sim", 0.50).alias("simulated_p50"),
        interpolated("_sim", 0.95).alias("simulated_p95"),
        "capacity_threshold",
        F.when(F.col("capacity_threshold").isNotNull(), exceeding).alias("exceedance_probability"),
        *[c for c in ("actual", "demand_regime") if c in scenarios.columns],
    )


def exact_exceedance(
    scenarios: DataFrame, pool: DataFrame, thresholds: DataFrame, keys: Keys = ()
) -> DataFrame:
    """Limit of the bootstrap for many draws: the share of residuals above the remaining headroom.

    Residuals and headrooms of a series are put in one order by value, where a running count tells how many
    residuals lie at or below each headroom.
    """
    limits = attach(scenarios, thresholds.select(*keys, "capacity_threshold"), keys)
    asked = limits.select(
        *keys, "date", "scenario", "adjusted_forecast",
        (F.col("capacity_threshold") - F.col("adjusted_forecast")).alias("_v"), F.lit(0).alias("_is"),
    )
    given = pool.select(*keys, F.col("residual").alias("_v"), F.lit(1).alias("_is"))
    both = asked.unionByName(given, allowMissingColumns=True)
    series = Window.partitionBy(*keys)
    below = F.sum("_is").over(series.orderBy(F.col("_v"), F.col("_is").desc()).rowsBetween(Window.unboundedPreceding, 0))
    size = F.nullif(F.sum("_is").over(series), F.lit(0))
    share = F.when(F.col("_v").isNotNull(), (size - below) / size)
    return both.withColumn("exceedance_probability", share).where("_is = 0").select(
        *keys, "date", "scenario", "adjusted_forecast", "exceedance_probability"
    )


def capacity_pressure(simulated: DataFrame, keys: Keys = ()) -> DataFrame:
    """Exceedance days, peak ranges and high-risk day counts of each scenario."""
    p = F.col("exceedance_probability")
    return simulated.groupBy(*keys, "scenario").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.max("capacity_threshold").alias("capacity_threshold"),
        F.sum(p).alias("expected_exceedance_days"),
        F.max(p).alias("max_exceedance_probability"),
        F.avg(p).alias("mean_exceedance_probability"),
        *[
            F.count_if(p > cut / 100).alias(f"days_with_exceedance_probability_above_{cut}pct")
            for cut in (25, 50, 75)
        ],
        F.max("simulated_p50").alias("simulated_peak_p50"),
        F.max("simulated_p95").alias("simulated_peak_p95"),
    )


def method_summary(
    simulated: DataFrame, thresholds: DataFrame, designs: DataFrame | None = None,
    base_note: str = "gradient_boosting_forecast; operational one-day-ahead baseline", keys: Keys = (),
) -> DataFrame:
    """One row per series: threshold, its definition, the scenarios, and the best design by MAPE."""
    place = F.array_position(F.array(*map(F.lit, SCENARIOS)), F.col("scenario"))
    present = simulated.groupBy(*keys, "scenario").agg(F.max(place).alias("_place"))
    listed = present.groupBy(*keys).agg(
        F.concat_ws(", ", F.transform(
            F.array_sort(F.collect_list(F.struct("_place", "scenario"))), lambda s: s["scenario"]
        )).alias("scenarios")
    )
    named = attach(
        listed,
        thresholds.select(*keys, "capacity_threshold", F.col("threshold_source").alias("threshold_definition")),
        keys,
    )
    if designs is None:
        best = F.lit("")
    else:
        choice = designs.where(F.col("mape").isNotNull()).agg(
            F.min_by(F.concat(
                "model", F.lit(" ("), "forecast_design", F.lit(") MAPE "),
                F.format_string("%.2f", "mape"), F.lit("%"),
            ), F.struct("mape", "model", "forecast_design")).alias("forecast_validation_context")
        )
        named = attach(named, choice, [])
        best = F.coalesce("forecast_validation_context", F.lit(""))
    return named.select(
        *keys, F.lit(base_note).alias("base_forecast"), F.lit(DESIGN_CAVEAT).alias("forecast_design_caveat"),
        "capacity_threshold", "threshold_definition", "scenarios", best.alias("forecast_validation_context"),
    )
