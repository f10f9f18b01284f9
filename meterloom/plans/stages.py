"""The workflow from raw records to exceedance probabilities, one function per stage.

Each stage takes and returns tables, so a stage can be run alone, on stored results of the one before, or
over a panel by naming the ``keys`` of a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.names import (
    CORRELATION_CANDIDATES, default_target, demand_columns, external_columns, numeric_columns, sarimax_regressors,
)
from meterloom.operators import (
    baseline, daily, evaluate, features, learn, profile, quality, recursive, sarimax, scenario, smoothing,
    stationarity,
)
from meterloom.operators.series import Keys
from meterloom.session import cut_lineage

Tables = dict[str, DataFrame]


def prepare(raw: DataFrame, target: str = "nd", ordinal: str = "ordinal", keys: Keys = ()) -> Tables:
    """Raw records to a duplicate audit and the daily table."""
    stamped = quality.ensure_stamp(raw)
    resolved = quality.resolve_duplicates(stamped, ordinal=ordinal, keys=keys)
    return {
        "duplicate_audit": quality.audit_duplicates(stamped, ordinal=ordinal, keys=keys),
        "daily": daily.daily_rollup(resolved, target, keys=keys),
    }


def explore(raw: DataFrame, ordinal: str = "ordinal", target: str | None = None) -> Tables:
    """Profile tables of raw records. Series statistics run on records with duplicates resolved.

    Every numeric column is correlated with the target and ranked by absolute value; the ten strongest that are no
    targets themselves are correlated with a lag.
    """
    stamped = quality.ensure_stamp(raw)
    target = target or default_target(raw)
    series = cut_lineage(quality.resolve_duplicates(stamped, ordinal=ordinal))
    stamp = quality.STAMP
    rows = stamped.select(ordinal, stamp, *[c for c in raw.columns if c not in (ordinal, stamp)])
    tables = {
        "column_summary": quality.column_profile(rows, ordinal),
        "missing_values": quality.missing_values(rows),
        "duplicates": quality.duplicate_row_counts(rows.drop(ordinal), stamp),
        "datetime_columns": stamped.sparkSession.createDataFrame(
            [(c,) for c in quality.detect_datetime_columns(rows, ordinal=ordinal)], "column string"),
        "external_columns": stamped.sparkSession.createDataFrame([(c,) for c in external_columns(raw)], "column string"),
        "time_steps": quality.step_summary(stamped),
        "gaps": quality.timestamp_gaps(stamped),
        "targets": profile.target_summary(rows, demand_columns(raw) or [target]),
        "patterns": profile.pattern_means(rows, stamp, target),
        "histogram": profile.histogram(rows, target),
        "null_map": quality.null_map(rows, F.to_date(stamp), [c for c in rows.columns if c not in (ordinal, stamp)], "day"),
        "density": profile.density_curve(rows, target),
        "weekend": profile.describe(rows.withColumn("is_weekend", F.weekday(stamp) >= 5), target, ["is_weekend"]),
        "outliers": quality.iqr_outliers(rows, target),
        "outlier_extremes": profile.extremes(quality.iqr_outliers(rows, target).select(ordinal, stamp, target), target, ordinal),
        "rolling": profile.rolling_statistics(series, stamp, target),
        "stationarity": stationarity.stationarity(series, stamp, target),
    }
    others = [c for c in numeric_columns(raw) if c not in (target, ordinal)]
    if others:
        found = cut_lineage(profile.correlations(rows, target, others))
        tables["correlations"] = evaluate.ranked(found, "correlation_with_target", ascending=False, tie="column", absolute=True)
        tables["correlation_matrix"] = profile.correlation_matrix(rows, [target, *others])
        top = profile.strongest(found, 10, [*demand_columns(raw), target])
        if top:
            tables["lagged_correlations"] = profile.lagged_correlations(series, stamp, target, top)
    period = profile.decomposition_period(series.limit(96).count())
    if period:
        tables["decomposition"] = profile.decompose(series, stamp, target, period)
    return tables


def baselines(table: DataFrame, target: str, start: str, end: str, keys: Keys = ()) -> Tables:
    """Naive, seasonal naive and smoothing forecasts of the densified target, with ranked metrics."""
    series = daily.densify(table.select(*keys, "date", target).where(F.col(target).isNotNull()), keys)
    train, test = daily.time_split(cut_lineage(series), start, end, target)
    forecasts = cut_lineage(evaluate.merge_forecasts(
        baseline.naive(train, test, target, keys),
        baseline.seasonal_naive(train, test, target, keys),
        smoothing.holt_winters(train, test, target, keys),
        keys=keys,
    ))
    scored = evaluate.metrics(evaluate.long_forecasts(forecasts, keys), [*keys, "model"])
    return {"forecasts": forecasts, "metrics": evaluate.ranked(scored, "mae", keys)}


def statistical(
    table: DataFrame, target: str, start: str, end: str, keys: Keys = (), earlier: Tables | None = None
) -> Tables:
    """Seasonal ARIMA with and without outside influences, next to earlier seasonal naive forecasts."""
    train, test = daily.time_split(table, start, end, target)
    made = evaluate.merge_forecasts(
        sarimax.sarima(train, test, target, keys),
        sarimax.sarimax(train, test, target, sarimax_regressors(table), keys),
        keys=keys,
    )
    scored = evaluate.metrics(evaluate.long_forecasts(cut_lineage(made), keys), [*keys, "model"])
    if earlier is None:
        return {"forecasts": made, "metrics": evaluate.in_model_order(scored)}
    made = cut_lineage(evaluate.merge_forecasts(
        made, earlier["forecasts"].select(*keys, "date", "seasonal_naive_forecast"), keys=keys
    ))
    both = earlier["metrics"].drop("rank").unionByName(scored, allowMissingColumns=True)
    return {
        "forecasts": made,
        "metrics": evaluate.in_model_order(both),
        "verdicts": evaluate.verdicts(both.where(F.col("model").isin("seasonal_naive", "sarima", "sarimax")), keys=keys),
    }


def diagnostics(
    table: DataFrame, forecasts: DataFrame, target: str, start: str, end: str, keys: Keys = (), peak: str | None = None
) -> Tables:
    """Error slices, residual autocorrelation, incomplete days, correlations and refined benchmarks."""
    errors = cut_lineage(evaluate.with_errors(evaluate.long_forecasts(forecasts, keys)))
    train, test = daily.time_split(daily.densify(table.select(*keys, "date", target), keys), start, end, target)
    yearly = baseline.seasonal_naive(train, test, target, keys).withColumnRenamed(
        "seasonal_naive_forecast", "year_over_year_seasonal_naive_forecast"
    )
    refined = evaluate.merge_forecasts(baseline.weekly_naive(train, test, target, keys), yearly, keys=keys)
    scored = evaluate.metrics(evaluate.long_forecasts(refined, keys), [*keys, "model"])
    inputs = [c for c in CORRELATION_CANDIDATES if c in table.columns]
    found = {
        "errors": errors,
        "error_slices": evaluate.error_slices(errors, keys),
        "residual_autocorrelation": evaluate.residual_autocorrelation(
            errors.where(F.col("model").isin("sarima", "sarimax")), keys),
        "incomplete_days": evaluate.incomplete_day_impact(errors, table, keys),
        "error_boxes": profile.box_statistics(errors, "error", [*keys, "model"]),
        "refined_benchmarks": evaluate.ranked(scored, "mae", keys),
    }
    if inputs:
        found["feature_correlations"] = profile.feature_correlations(
            table, inputs, [c for c in (target, peak) if c], keys
        )
    return found


def feature_models(
    table: DataFrame, target: str, start: str, end: str, keys: Keys = (), earlier: list[DataFrame] | None = None,
    models: list[str] | None = None, settings: dict[str, dict] | None = None,
) -> Tables:
    """One-day-ahead feature models; ``earlier`` metric tables join the comparison, later ones winning."""
    forecasts, fitted = learn.one_day_ahead(table, target, start, end, keys, models, settings)
    forecasts = cut_lineage(forecasts)
    scored = evaluate.metrics(evaluate.long_forecasts(forecasts, keys, ["demand_regime"]), [*keys, "model"])
    known = [t.select(*keys, "model", "mae", "rmse", "mape") for t in earlier or []]
    comparison = evaluate.keep_by_priority(
        evaluate.stacked(*known, scored.select(*keys, "model", "mae", "rmse", "mape")), [*keys, "model"]
    )
    tables = {
        "forecasts": forecasts,
        "metrics": evaluate.ranked(comparison.drop("priority"), "mae", keys),
        "regime_metrics": learn.regime_metrics(forecasts, keys),
    }
    if fitted.trees:
        tables["importance"] = learn.importance_table(fitted)
        tables["mean_importance"] = learn.mean_importance(tables["importance"])
    if fitted.ridge is not None:
        tables["ridge_coefficients"] = learn.ridge_coefficients(fitted)
    return tables


def validation(
    table: DataFrame, target: str, start: str, end: str, operational: DataFrame, exogenous: str = "drop",
    models: list[str] | None = None, settings: dict[str, dict] | None = None, keys: Keys = (),
) -> Tables:
    """Feature audit, strict recursive forecasts and the comparison of forecast designs."""
    chosen = models or learn.MODELS
    forecasts, _ = recursive.strict_recursive(table, target, start, end, keys, exogenous, chosen, settings)
    forecasts = cut_lineage(forecasts)
    frame = features.feature_frame(table, target, start, keys)
    columns = features.feature_columns(frame, target)
    design = lambda df, name: df.withColumn("forecast_design", F.lit(name))
    # the benchmark looks up the training rows that are complete, as the models do
    used = features.strict_columns(columns, exogenous)
    train = frame.where(F.col("date") < F.lit(start).cast("date")).na.drop(subset=[target, *used])
    _, test = daily.time_split(table, start, end, target)
    yearly = evaluate.long_forecasts(baseline.seasonal_naive(train, test, target, keys, use_365=False), keys)
    strict = design(evaluate.metrics(forecasts, [*keys, "model"]), f"strict_recursive_{exogenous}_exog").unionByName(
        design(evaluate.metrics(yearly, [*keys, "model"]), "benchmark")
    )
    summary = evaluate.operational_summary(operational, target, start, end, chosen, keys)
    audit = features.feature_audit(table.sparkSession, columns, exogenous)
    return {
        "feature_audit": audit,
        "audit_counts": features.audit_counts(audit),
        "operational_summary": summary,
        "forecasts": forecasts,
        "regime_metrics": evaluate.metrics(forecasts, [*keys, "demand_regime", "model"]),
        "design_comparison": evaluate.compare_designs(summary, strict, keys=keys),
    }


def scenarios(
    table: DataFrame, forecasts: DataFrame, target: str, start: str, end: str, keys: Keys = (),
    base: str = "gradient_boosting_forecast", draws: int = 1000, seed: int = 42, threshold: float | None = None,
    designs: DataFrame | None = None,
) -> Tables:
    """Simulated ranges and capacity pressure of a base forecast under the stress scenarios."""
    window = forecasts.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if window.isEmpty():
        raise ValueError("no forecasts fall into the test period")
    context = cut_lineage(scenario.add_context(scenario.choose_base(window, base), table, target, start, end, keys))
    limits = cut_lineage(scenario.capacity_threshold(table, target, start, keys, threshold))
    rows = scenario.scenario_rows(context, table, start, keys)
    simulated = cut_lineage(
        scenario.bootstrap(rows, scenario.residual_pool(context, keys), limits, draws, seed, keys)
    )
    pressure = scenario.capacity_pressure(simulated, keys)
    return {
        "daily": simulated,
        "summary": evaluate.ranked(pressure, "expected_exceedance_days", keys, False, "scenario"),
        "threshold": limits,
        "method": scenario.method_summary(simulated, limits, designs, f"{base}; operational one-day-ahead baseline", keys),
    }
