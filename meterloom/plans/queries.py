"""Registered queries: every operator on the whole order, line item and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.clock import (
    add_calendar, expected_periods, last_sunday, parse_stamp,
)
from meterloom.functions.names import numeric_columns, sarimax_regressors
from meterloom.operators import (
    baseline, daily, evaluate, features, learn, profile, quality, recursive, regression, scenario, smoothing, stationarity,
)
from meterloom.operators import sarimax as sarimax_
from meterloom.operators.quantiles import exact_quantiles, union_all
from meterloom.operators.series import attach
from meterloom.plans.adapters import (
    EXOGENOUS, SERIES, TARGET, TEST_END, TEST_START, daily_exogenous, daily_joined, daily_orders,
    half_hourly, table,
)
from meterloom.session import cut_lineage, shared_path
from meterloom.sources import manifest, tables
from meterloom.sources.tables import union_yearly

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def shown(df: DataFrame) -> DataFrame:
    """Round fractions to 6 digits and widen whole numbers, so results compare across engines.

    Means of money amounts often end exactly on half of the last digit. The bits in which two orders of summation
    differ are rounded away first, at 8 digits, so that such a half is one in every engine.
    """
    def cell(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(F.round(F.col(f.name), 8), 6).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            return F.col(f.name).cast("long").alias(f.name)
        return F.col(f.name)

    return df.select(*map(cell, df.schema))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: shown(fn(spark, folder))
    return fn


# --- shared inputs -------------------------------------------------------------------------------

def stored_orders(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Daily order table, written once because the plans below read it in many places."""
    return cut_lineage(daily_orders(spark, folder, keys))


def sides(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    return daily.time_split(orders, TEST_START, TEST_END, TARGET, check=False)


def stamped(spark: SparkSession, folder: str) -> DataFrame:
    return quality.add_stamp(half_hourly(spark, folder))


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    return quality.resolve_duplicates(stamped(spark, folder))


def stored_half_hours(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(resolved(spark, folder))


def naive_table(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Test days with the three naive forecasts side by side."""
    train, test = sides(orders)
    return evaluate.merge_forecasts(
        baseline.seasonal_naive(train, test, TARGET, keys),
        baseline.naive(train, test, TARGET, keys),
        baseline.weekly_naive(train, test, TARGET, keys),
        keys=keys,
    )


def naive_long(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    keys = SERIES if keys is None else keys
    return evaluate.long_forecasts(naive_table(stored_orders(spark, folder, keys), keys), keys)


def naive_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the naive forecasts by series, written once: slices and cuts read them repeatedly."""
    return cut_lineage(evaluate.with_errors(naive_long(spark, folder)))


def scenario_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Seasonal naive as base forecast in its context, and the daily table it came from."""
    joined = cut_lineage(daily_joined(spark, folder))
    table_ = features.training_regime(joined, TARGET, TEST_START, SERIES)
    train, test = daily.time_split(table_, TEST_START, TEST_END, TARGET, check=False)
    forecasts = baseline.seasonal_naive(train, test, TARGET, SERIES)
    base = scenario.choose_base(forecasts, "seasonal_naive_forecast")
    return scenario.add_context(base, table_, TARGET, TEST_START, TEST_END, SERIES), table_


# --- sources ---------------------------------------------------------------------------------------

@query
def yearly_union(spark, folder):
    """Yearly tables, the first of which lacks a column."""
    orders, year = table(spark, folder, "orders"), F.year("o_orderdate")
    first = orders.agg(F.min(year)).first()[0]
    named = orders.select(
        F.col("o_orderkey").alias(" Order-Key "), F.col("o_totalprice").alias("Total  Price"),
        F.col("o_orderstatus").alias("Order Status"), year.alias("source_year"),
    )
    return union_yearly([
        named.where(F.col("source_year") == first).drop("Order Status"), named.where(F.col("source_year") > first)
    ])


def resources(spark, folder):
    """One manifest resource per order year, status and priority."""
    orders = table(spark, folder, "orders")
    year = (F.year("o_orderdate") + 24).cast("string")
    groups = orders.groupBy(
        year.alias("y"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")
    ).agg(F.min("o_orderkey").alias("position"))
    named = F.concat(F.lit("Historic Demand-Data "), "y")
    link = F.concat(F.lit("https://data.example/f/DemandData_"), "y", F.lit(".CSV?v=1"))
    return groups.select(
        "position",
        F.col("position").cast("string").alias("id"),
        F.when(F.col("s") == "F", named).alias("name"),
        F.when(F.col("s") == "P", F.concat(F.lit("Notes "), "y")).alias("title"),
        F.when(F.col("s") == "F", "CSV").when(F.col("s") == "P", "").alias("format"),
        F.when(F.col("s") == "P", "application/json").alias("mimetype"),
        F.when(F.col("p") != "5-LOW", link).alias("url"),
        F.when(F.col("p") == "5-LOW", F.concat(F.lit("/files/"), "y", F.lit(".json"))).alias("path"),
        F.lit(None).cast("string").alias("last_modified"),
        F.col("p").alias("metadata_modified"),
        (F.col("s") == "O").alias("datastore_active"),
    )


@query
def manifest_inventory(spark, folder):
    inventory = manifest.manifest_inventory(resources(spark, folder))
    chosen = manifest.select_years(inventory, 2020, current_year=2025)
    return manifest.manifest_inventory(resources(spark, folder), chosen)


@query
def manifest_from_json(spark, folder):
    """Resources read from the JSON texts of all events: those of views say ``id``, others ``k``, and errors are cut off."""
    events, kind = table(spark, folder, "events"), F.col("event_type")
    text = F.when(kind == "view", F.replace("props", F.lit('"k"'), F.lit('"id"'))).when(
        kind == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    found = manifest.resources_from_text(
        events.select("event_id", "event_type", text.alias("document")), "document", {"id": ("id", "k")}, ("event_id", "event_type"), None)
    return found.select("event_id", "event_type", "position", "id")


@query
def manifest_documents(spark, folder):
    """The inventory of manifests that Spark writes as texts, one a priority, and reads back; empty fields have no key."""
    fields = F.struct("position", "id", "name", "title", "format", "mimetype", "url", "path", "last_modified", "metadata_modified", "datastore_active")
    texts = resources(spark, folder).groupBy(F.col("metadata_modified").alias("of")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(fields)).alias("resources"))).alias("document"))
    rows = manifest.resources_from_text(texts, "document", carry=("of",))
    return manifest.manifest_inventory(rows).withColumn("position", F.col("resource_id").cast("long"))


@query
def table_round_trip(spark, folder):
    """Three years of the daily panel, read through a validated scan of a partitioned table whose middle year was written
    again, and a table that was never made."""
    path = shared_path(spark, "sink")
    panel = cut_lineage(daily_orders(spark, folder).withColumns({"year": F.year("date"), "date": F.col("date").cast("string")}))
    tables.write_table(panel, path, ["year"])
    for _ in range(2):
        tables.replace_partitions(panel.where("year = 1996").withColumn("value_peak", F.col("value_peak") + 1), path, ["year"])
    stored = tables.read_daily(spark, path, panel.schema).where(F.col("year").between(1995, 1997))
    return stored.unionByName(tables.validated_dates(tables.read_optional(spark, f"{path}-later", panel.schema)))


@query
def datetime_columns(spark, folder):
    """Which text columns of the orders hold timestamps, by their first values."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", day.alias("day"), F.when(F.col("o_orderstatus") != "P", day).alias("gappy"),
        F.when(F.col("o_orderstatus") == "F", day).otherwise("open").alias("mixed"))
    shares = quality.datetime_shares(orders, "o_orderkey")
    return shares.withColumn("is_datetime", F.col("parsed") >= 0.8 * F.col("sampled"))


@query
def select_years(spark, folder):
    return manifest.select_years(
        manifest.manifest_inventory(resources(spark, folder)), 2020, current_year=2025
    )


# --- clock and quality -------------------------------------------------------------------------------

@query
def half_hour_stamp(spark, folder):
    return stamped(spark, folder).select(
        "ordinal", "settlement_date", "settlement_period", "settlement_datetime"
    )


@query
def repair_stamp(spark, folder):
    """A text timestamp that is unreadable for one kind of event and rebuilt from date and period."""
    raw = stamped(spark, folder)
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.date_format("settlement_datetime", "yyyy-MM-dd HH:mm:ss")
    )
    broken = raw.withColumn("settlement_datetime", text)
    return quality.ensure_stamp(broken).select("ordinal", "settlement_datetime")


@query
def parse_dates(spark, folder):
    orders = table(spark, folder, "orders")
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    text = (
        F.when(status == "F", F.upper(F.date_format(day, "dd-MMM-yyyy")))
        .when(status == "O", F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd")))
        .otherwise("not a date")
    )
    return orders.select("o_orderkey", F.date_format(parse_stamp(text), "yyyy-MM-dd").alias("parsed"))


@query
def expected_period_counts(spark, folder):
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select(
        "date", last_sunday(F.col("date")).alias("last_sunday"),
        expected_periods(F.col("date")).alias("expected"),
    )


@query
def coerce_numeric(spark, folder):
    orders = table(spark, folder, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    return daily.coerce_numeric(orders.select("o_orderkey", text.alias("reading")), ["reading"])


@query
def complete_cases(spark, folder):
    return daily.complete_cases(daily_joined(spark, folder), [TARGET, *EXOGENOUS])


@query
def time_split(spark, folder):
    train, test = daily.time_split(stored_orders(spark, folder), TEST_START, TEST_END, TARGET)
    return union_all([
        side.select(*SERIES, "date", TARGET, F.lit(name).alias("side"))
        for name, side in (("train", train), ("test", test))
    ])


@query
def window_predicates(spark, folder):
    """Suspicious values, and rows of a shock period, per event type."""
    events = table(spark, folder, "events")
    return events.where(
        (F.col("value") <= 0.5)
        | F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    ).select("event_id", "event_type", "ts", "value")


@query
def member_filters(spark, folder):
    """Series days with and without any shipment, and whether the series is one of a list."""
    panel = daily_orders(spark, folder).withColumn("listed", F.col("series").isin("1-URGENT", "2-HIGH"))
    shipped = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return union_all([
        panel.join(shipped, "date", how).select("series", "date", "listed", F.lit(how).alias("kind"))
        for how in ("left_semi", "left_anti")
    ])


@query
def quantiles(spark, folder):
    orders = table(spark, folder, "orders")
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95}
    return exact_quantiles(orders, "o_totalprice", probs, ["o_orderpriority"])


@query
def dup_audit(spark, folder):
    return quality.audit_duplicates(stamped(spark, folder))


@query
def dup_resolve(spark, folder):
    return resolved(spark, folder)


@query
def daily_coverage(spark, folder):
    return daily.daily_rollup(resolved(spark, folder))


@query
def ts_gaps(spark, folder):
    """Half-hours in which nothing happened, whatever the kind of event."""
    return quality.timestamp_gaps(stamped(spark, folder))


@query
def ts_gaps_by_key(spark, folder):
    return quality.timestamp_gaps(stamped(spark, folder), keys=["event_type"])


@query
def step_inference(spark, folder):
    seen = quality.distinct_stamps(stamped(spark, folder), keys=["event_type"])
    by_kind = quality.step_summary(seen, keys=["event_type"], distinct=True)
    whole = quality.step_summary(seen).withColumn("event_type", F.lit("all"))
    return by_kind.unionByName(whole)


# --- profiles ------------------------------------------------------------------------------------------

@query
def column_profile(spark, folder):
    orders = table(spark, folder, "orders")
    return quality.column_profile(
        orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")),
        "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority", "day"],
    )


@query
def column_profile_sketch(spark, folder):
    """Sketches of every event column, made by month and merged, against exact counts: whether they keep their bounds."""
    events = cut_lineage(table(spark, folder, "events").withColumn("month", by_month("ts")))
    columns, probs = ["event_id", "user_id", "event_type", "props", "value"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    merged = quality.merged_sketches(cut_lineage(quality.sketches(events, columns, ["month"])))
    profile_ = cut_lineage(quality.sketch_profile(merged, columns, probs))
    exact = union_all([events.agg(F.lit(c).alias("column"), F.count_distinct(c).alias("unique_count")) for c in columns])
    # Five deviations of the distinct count, and one per cent of the ranks.
    off = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 5 * 1.04 / 2 ** (quality.DISTINCT_BITS / 2) * F.col("unique_count") + 1
    cut = profile_.where("column in ('user_id', 'value')").select("column", *[F.col(p) for p in probs])
    values = events.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("user_id", "value")])).alias("_e")).select("_e.*")
    ranks = values.join(cut, "column").groupBy("column").agg(*[
        ((F.avg((F.col("v") <= F.col(name)).cast("int")) >= p - 0.01) & (F.avg((F.col("v") < F.col(name)).cast("int")) <= p + 0.01)).alias(f"{name}_kept")
        for name, p in probs.items()])
    return profile_.join(exact, "column").join(ranks, "column", "left").select(
        "column", "non_null_count", "missing_count", "unique_count", off.alias("unique_kept"), *[f"{p}_kept" for p in probs])


@query
def missing_values(spark, folder):
    return quality.missing_values(half_hourly(spark, folder))


@query
def dup_rows(spark, folder):
    return quality.duplicate_row_counts(
        half_hourly(spark, folder).select("settlement_date", "settlement_period", "event_type"),
        "settlement_date",
    )


@query
def target_summary(spark, folder):
    return profile.target_summary(half_hourly(spark, folder), ["nd", "tsd"])


@query
def describe_weekend(spark, folder):
    halves = stored_half_hours(spark, folder).withColumn(
        "is_weekend", F.weekday("settlement_datetime") >= 5
    )
    return profile.describe(halves, "nd", ["is_weekend"])


@query
def pattern_means(spark, folder):
    return profile.pattern_means(stamped(spark, folder), "settlement_datetime", "nd")


@query
def histogram50(spark, folder):
    return profile.histogram(table(spark, folder, "orders"), "o_totalprice", 50)


@query
def density(spark, folder):
    """Density per million, so that six digits carry information."""
    curve = profile.density_curve(table(spark, folder, "orders"), "o_totalprice")
    return curve.withColumn("density", F.col("density") * 1e6)


@query
def iqr_outliers(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return quality.iqr_outliers(events, "value", ["event_type"])


@query
def outlier_extremes(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    found = quality.iqr_outliers(events, "value").select("event_id", "value")
    return profile.extremes(found, "value", "event_id", 20)


@query
def recent_rows(spark, folder):
    return profile.recent_rows(half_hourly(spark, folder).select("ordinal", "nd"), ["ordinal"], 5000)


@query
def null_map(spark, folder):
    raw = half_hourly(spark, folder)
    return quality.null_map(
        raw, F.col("settlement_date"), ["tsd", "embedded_wind_generation", "pump_storage_pumping"], "day"
    )


@query
def corr_target(spark, folder):
    return profile.correlations(
        daily_joined(spark, folder), TARGET, ["value_peak", *EXOGENOUS], SERIES
    )


@query
def corr_ranked(spark, folder):
    """Correlations of every numeric column with the target, the strongest first whatever its sign."""
    joined = daily_joined(spark, folder)
    found = profile.correlations(joined, TARGET, [c for c in numeric_columns(joined) if c != TARGET], SERIES)
    return evaluate.ranked(found, "correlation_with_target", SERIES, False, "column", absolute=True)


@query
def corr_matrix(spark, folder):
    return profile.correlation_matrix(daily_joined(spark, folder, []), [TARGET, "value_peak", *EXOGENOUS])


@query
def corr_features(spark, folder):
    joined = add_calendar(daily_joined(spark, folder), only=["is_weekend", "month", "day_of_week"])
    return profile.feature_correlations(
        joined, [*EXOGENOUS, "is_weekend", "month", "day_of_week"], [TARGET, "value_peak"], SERIES
    )


@query
def lag_corr(spark, folder):
    return profile.lagged_correlations(
        stored_half_hours(spark, folder), "settlement_datetime", "nd", ["tsd", "embedded_wind_generation"], block=500
    )


@query
def lag_corr_top(spark, folder):
    """Lagged correlations of the ten columns that correlate most with the target."""
    series = stored_half_hours(spark, folder)
    others = [c for c in numeric_columns(series) if c not in ("nd", "duplicate_count")]
    top = profile.strongest(profile.correlations(series, "nd", others), 10)
    return profile.lagged_correlations(series, "settlement_datetime", "nd", top, block=500)


@query
def rolling_stats(spark, folder):
    return profile.rolling_statistics(stored_half_hours(spark, folder), "settlement_datetime", "nd", block=500)


@query
def rolling_latest(spark, folder):
    curve = profile.rolling_statistics(stored_half_hours(spark, folder), "settlement_datetime", "nd", block=500)
    return profile.latest_rolling(curve, "settlement_datetime")


@query
def decompose(spark, folder):
    return profile.decompose(stored_orders(spark, folder), "date", TARGET, 7, SERIES, block=500)


@query
def decompose_half_hours(spark, folder):
    return profile.decompose(stored_half_hours(spark, folder), "settlement_datetime", "nd", 48, block=500)


# --- daily features ------------------------------------------------------------------------------------

@query
def calendar(spark, folder):
    return add_calendar(daily_orders(spark, folder, []).select("date"))


@query
def densify(spark, folder):
    return daily.densify(stored_orders(spark, folder), SERIES)


@query
def fill_exog(spark, folder):
    target = daily.densify(stored_orders(spark, folder), SERIES).select("series", "date")
    return daily.fill_gaps(target.join(daily_exogenous(spark, folder), "date", "left"), EXOGENOUS, SERIES)


def by_month(stamp: str):
    """Months since year 0, a bucket that follows time."""
    return F.year(stamp) * 12 + F.month(stamp)


@query
def fill_half_hours(spark, folder):
    """Gaps of the half-hourly series, filled month by month."""
    gappy = ["tsd", "embedded_wind_generation", "pump_storage_pumping"]
    series = stored_half_hours(spark, folder).select("settlement_datetime", *gappy)
    return daily.fill_gaps(series, gappy, [], "settlement_datetime", by_month("settlement_datetime"))


@query
def align_exog(spark, folder):
    target = daily.densify(stored_orders(spark, folder, []), []).select("date")
    return daily.align_to_calendar(target, daily_exogenous(spark, folder), EXOGENOUS)


@query
def zscore_train(spark, folder):
    joined = cut_lineage(daily.complete_cases(daily_joined(spark, folder), EXOGENOUS))
    train, test = daily.time_split(joined, TEST_START, TEST_END, check=False)
    return daily.standardise(test, train, EXOGENOUS, SERIES).select("series", "date", *EXOGENOUS)


@query
def zscore_train_population(spark, folder):
    joined = cut_lineage(daily.complete_cases(daily_joined(spark, folder), EXOGENOUS))
    train, test = daily.time_split(joined, TEST_START, TEST_END, check=False)
    return daily.standardise(test, train, EXOGENOUS, SERIES, True).select("series", "date", *EXOGENOUS)


@query
def median_impute(spark, folder):
    joined = daily.densify(cut_lineage(daily_joined(spark, folder)), SERIES)
    train, _ = daily.time_split(joined, TEST_START, TEST_END, check=False)
    return daily.impute_median(joined, train, [TARGET, *EXOGENOUS], SERIES)


@query
def lags(spark, folder):
    featured = features.history_features(daily_orders(spark, folder), TARGET, SERIES)
    return featured.select("series", "date", *[f"lag_{k}" for k in features.LAGS])


@query
def lags_calendar(spark, folder):
    featured = features.history_features(
        stored_orders(spark, folder, []), TARGET, [], mode="calendar", block=400
    )
    return featured.select("date", *[f"lag_{k}" for k in features.LAGS])


@query
def lags_rows_blocked(spark, folder):
    """Lags and windows of the half-hourly series by rows, in blocks."""
    series = stored_half_hours(spark, folder).select("settlement_datetime", "nd")
    return features.history_features(series, "nd", [], "rows", 1000, "settlement_datetime", by_month("settlement_datetime"))


@query
def rolling_shifted(spark, folder):
    featured = features.history_features(daily_orders(spark, folder), TARGET, SERIES)
    return featured.select("series", "date", *features.ROLLING)


@query
def regime_train(spark, folder):
    orders = stored_orders(spark, folder)
    return features.training_regime(orders, TARGET, TEST_START, SERIES, keep_thresholds=True)


@query
def regime_eval(spark, folder):
    errors = naive_errors(spark, folder).where("model = 'naive'").select("series", "date", "actual")
    return evaluate.period_columns(errors, SERIES)


@query
def feature_audit(spark, folder):
    """Availability class of each model input, with the rows of the whole panel that carry it."""
    frame = features.feature_frame(daily_joined(spark, folder), TARGET, TEST_START, SERIES)
    columns = features.feature_columns(frame, TARGET)
    known = frame.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "feature", "known_rows")
    return features.feature_audit(spark, columns).join(known, "feature")


@query
def audit_counts(spark, folder):
    frame = features.feature_frame(daily_joined(spark, folder), TARGET, TEST_START, SERIES)
    columns = features.feature_columns(frame, TARGET)
    known = frame.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "feature", "known_rows")
    audit = features.feature_audit(spark, columns).join(known, "feature")
    rows = audit.groupBy("feature_type").agg(F.sum("known_rows").alias("known_rows"))
    return features.audit_counts(audit).join(rows, "feature_type")


@query
def leakage_check(spark, folder):
    featured = features.history_features(daily_orders(spark, folder), TARGET, SERIES)
    return features.leakage_check(featured, TARGET, SERIES)


# --- baselines and evaluation -------------------------------------------------------------------------

@query
def naive(spark, folder):
    train, test = sides(stored_orders(spark, folder))
    return baseline.naive(train, test, TARGET, SERIES)


@query
def seasonal_naive(spark, folder):
    train, test = sides(stored_orders(spark, folder))
    return baseline.seasonal_naive(train, test, TARGET, SERIES)


@query
def seasonal_naive_strict(spark, folder):
    train, test = sides(stored_orders(spark, folder))
    return baseline.seasonal_naive(train, test, TARGET, SERIES, use_365=False)


@query
def weekly_naive(spark, folder):
    train, test = sides(stored_orders(spark, folder))
    return baseline.weekly_naive(train, test, TARGET, SERIES)


@query
def seasonal_naive_metrics(spark, folder):
    """Accuracy of the yearly seasonal naive forecast of the single daily series, gaps made explicit."""
    train, test = sides(daily.densify(stored_orders(spark, folder, []), []))
    long = evaluate.long_forecasts(baseline.seasonal_naive(train, test, TARGET))
    return evaluate.metrics(long, ["model"])


@query
def metrics(spark, folder):
    long = naive_long(spark, folder)
    return evaluate.metrics(long, [*SERIES, "model"])


@query
def ranked_metrics(spark, folder):
    long = naive_long(spark, folder)
    return evaluate.ranked(evaluate.metrics(long, [*SERIES, "model"]), "mae", SERIES)


@query
def model_order(spark, folder):
    long = naive_long(spark, folder)
    return evaluate.in_model_order(evaluate.metrics(long, [*SERIES, "model"]))


@query
def refined_benchmark(spark, folder):
    train, test = sides(stored_orders(spark, folder, []))
    weekly = baseline.weekly_naive(train, test, TARGET)
    yearly = baseline.seasonal_naive(train, test, TARGET).withColumnRenamed(
        "seasonal_naive_forecast", "year_over_year_seasonal_naive_forecast"
    )
    long = evaluate.long_forecasts(evaluate.merge_forecasts(weekly, yearly))
    return evaluate.ranked(evaluate.metrics(long, ["model"]), "mae")


@query
def forecast_merge(spark, folder):
    return naive_table(stored_orders(spark, folder), SERIES)


@query
def align_inner(spark, folder):
    """Actuals of each series aligned with the forecast of the whole, where both exist."""
    train, test = sides(stored_orders(spark, folder, []))
    forecast = baseline.seasonal_naive(train, test, TARGET).select("date", "seasonal_naive_forecast")
    return evaluate.aligned(daily_orders(spark, folder).select("series", "date", TARGET), forecast)


@query
def error_slices(spark, folder):
    return evaluate.error_slices(naive_errors(spark, folder), SERIES)


@query
def slice_pivot(spark, folder):
    slices = evaluate.error_slices(naive_errors(spark, folder), SERIES)
    return evaluate.slice_pivot(
        slices, "month", "mae", ["naive", "seasonal_naive", "weekly_seasonal_naive"], SERIES
    )


@query
def regime_metrics(spark, folder):
    orders = stored_orders(spark, folder)
    labelled = features.training_regime(orders, TARGET, TEST_START, SERIES)
    errors = evaluate.long_forecasts(naive_table(orders, SERIES), SERIES)
    joined = errors.join(labelled.select(*SERIES, "date", "demand_regime"), [*SERIES, "date"], "left")
    return evaluate.metrics(joined, [*SERIES, "demand_regime", "model"])


@query
def box_stats(spark, folder):
    return profile.box_statistics(naive_errors(spark, folder), "error", [*SERIES, "model"])


@query
def top_days(spark, folder):
    """The ten best days of each series."""
    return evaluate.top_per_group(daily_orders(spark, folder), SERIES, TARGET, 10, "date")


@query
def residual_acf(spark, folder):
    return evaluate.residual_autocorrelation(naive_errors(spark, folder), SERIES)


@query
def residual_acf_half_hours(spark, folder):
    """Autocorrelation of the errors of two half-hourly forecasts: the value a day and a week before."""
    series = stored_half_hours(spark, folder).select("settlement_datetime", "nd")
    earlier = lambda name, days: series.join(series.select(
        (F.col("settlement_datetime") + F.expr(f"INTERVAL {days} DAY")).alias("settlement_datetime"), F.col("nd").alias("forecast")
    ), "settlement_datetime").select(F.lit(name).alias("model"), "settlement_datetime", (F.col("nd") - F.col("forecast")).alias("error"))
    errors = cut_lineage(union_all([earlier("day before", 1), earlier("week before", 7)]))
    return evaluate.residual_autocorrelation(errors, [], 48, "settlement_datetime", by_month("settlement_datetime"), 500)


@query
def incomplete_impact(spark, folder):
    """Errors next to order counts as coverage: days with fewer orders than the series' usual are incomplete."""
    orders = table(spark, folder, "orders")
    counts = orders.groupBy(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")
    ).agg(F.count(F.lit(1)).alias("settlement_period_count"))
    usual = counts.groupBy("series").agg(F.max("settlement_period_count").alias("expected_settlement_period_count"))
    ratio = F.col("settlement_period_count") / F.col("expected_settlement_period_count")
    coverage = attach(counts, usual, SERIES).withColumn("coverage_ratio", ratio).withColumn(
        "has_incomplete_day", F.col("coverage_ratio") < 1
    )
    return evaluate.incomplete_day_impact(naive_errors(spark, folder), coverage, SERIES)


@query
def verdict(spark, folder):
    long = naive_long(spark, folder)
    return evaluate.verdicts(evaluate.metrics(long, [*SERIES, "model"]), keys=SERIES)


@query
def metrics_union(spark, folder):
    """Metrics of the first half of the year, replaced by whole-year ones where a model has both."""
    long = naive_long(spark, folder, [])
    half = evaluate.metrics(long.where(F.col("date") < F.lit("2000-07-01").cast("date")), ["model"])
    whole = evaluate.metrics(long.where(F.col("model") != "naive"), ["model"]).drop("rmse")
    return evaluate.metrics_union(half, whole)


@query
def design_comparison(spark, folder):
    long = naive_long(spark, folder, [])
    saved = evaluate.metrics(long, ["model"])
    operational = evaluate.operational_summary(
        saved, TARGET, TEST_START, TEST_END, ["naive", "weekly_seasonal_naive", "ridge"]
    )
    label = lambda t, d: t.withColumn("forecast_design", F.lit(d))
    strict = label(saved.where("model <> 'seasonal_naive'"), "strict_recursive_drop_exog")
    bench = label(saved.where("model = 'seasonal_naive'"), "benchmark")
    return evaluate.compare_designs(operational, strict.unionByName(bench), bench)


# --- scenarios ------------------------------------------------------------------------------------------

@query
def threshold(spark, folder):
    return scenario.capacity_threshold(daily_orders(spark, folder), TARGET, TEST_START, SERIES)


@query
def context_join(spark, folder):
    return scenario_inputs(spark, folder)[0]


@query
def residual_pool(spark, folder):
    return scenario.residual_pool(scenario_inputs(spark, folder)[0], SERIES)


@query
def scenario_rows(spark, folder):
    context, table_ = scenario_inputs(spark, folder)
    return scenario.scenario_rows(context, table_, TEST_START, SERIES).select(
        "series", "date", "scenario", "demand_regime", "low_renewable", "base_forecast",
        "scenario_uplift_pct", "adjusted_forecast", "scenario_assumption",
    )


def simulated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    context, table_ = scenario_inputs(spark, folder)
    thresholds = scenario.capacity_threshold(table_, TARGET, TEST_START, SERIES)
    rows = scenario.scenario_rows(context, table_, TEST_START, SERIES)
    pool = scenario.residual_pool(context, SERIES)
    return scenario.bootstrap(rows, pool, thresholds, keys=SERIES), thresholds


@query
def bootstrap_daily(spark, folder):
    return simulated(spark, folder)[0]


@query
def bootstrap_exact(spark, folder):
    context, table_ = scenario_inputs(spark, folder)
    thresholds = scenario.capacity_threshold(table_, TARGET, TEST_START, SERIES)
    rows = scenario.scenario_rows(context, table_, TEST_START, SERIES)
    return scenario.exact_exceedance(rows, scenario.residual_pool(context, SERIES), thresholds, SERIES)


@query
def capacity_pressure(spark, folder):
    pressure = scenario.capacity_pressure(simulated(spark, folder)[0], SERIES)
    return evaluate.ranked(pressure, "expected_exceedance_days", SERIES, ascending=False, tie="scenario")


@query
def scenario_method(spark, folder):
    draws, thresholds = simulated(spark, folder)
    return scenario.method_summary(
        draws, thresholds, design_comparison(spark, folder), "seasonal_naive_forecast", SERIES
    )


# --- models -----------------------------------------------------------------------------------------------

def modelled(spark: SparkSession, folder: str) -> DataFrame:
    """All daily series with outside influences."""
    return cut_lineage(daily_joined(spark, folder))


def matrix(spark, folder):
    """Stored training and test rows of all series, and their inputs."""
    return learn.model_matrix(modelled(spark, folder), TARGET, TEST_START, TEST_END, SERIES)


def ahead(spark, folder, *models):
    """One-day-ahead forecasts of the named models, and the models.

    A full-length ensemble takes minutes and several queries show tables of the same one, so it is kept in the shared
    folder under a mark of its training rows.
    """
    train, test, columns = matrix(spark, folder)
    fitted = learn.fit_models(train, TARGET, columns, SERIES, list(models), store=True)
    return learn.predict(fitted, test), fitted


@query
def ridge_forecast(spark, folder):
    """One ridge model per priority series."""
    return ahead(spark, folder, "ridge")[0]


@query
def ridge_coefficients(spark, folder):
    return learn.ridge_coefficients(ahead(spark, folder, "ridge")[1])


@query
def ridge_residual_check(spark, folder):
    """Distance of every ridge model from its normal equations, zero to six digits."""
    train, _, columns = matrix(spark, folder)
    flags = {f.name: F.col(f.name).cast("int") for f in train.schema if f.name in columns and f.dataType.simpleString() == "boolean"}
    train = cut_lineage(train.withColumns(flags))
    model = learn.fit_models(train, TARGET, columns, SERIES, ["ridge"]).ridge
    return regression.ridge_residuals(model, train, TARGET, columns, SERIES)


@query
def forest_forecast(spark, folder):
    return ahead(spark, folder, "random_forest")[0]


@query
def gbt_forecast(spark, folder):
    return ahead(spark, folder, "gradient_boosting")[0]


@query
def importance_top(spark, folder):
    """Fifteen most important inputs of each tree model, and twenty by mean importance."""
    _, fitted = ahead(spark, folder, "random_forest", "gradient_boosting")
    return top_importance(learn.importance_table(fitted))


def top_importance(importance: DataFrame) -> DataFrame:
    mean = learn.mean_importance(importance).withColumn("model", F.lit("mean"))
    return union_all([
        evaluate.top_per_group(importance, ["model"], "importance", 15, "feature"),
        evaluate.top_per_group(mean, ["model"], "importance", 20, "feature"),
    ])


@query
def importance_rule(spark, folder):
    """The ranking of importances over a table that SQL can build: absolute correlations of each series' inputs."""
    joined = add_calendar(daily_joined(spark, folder), only=["is_weekend", "month", "day_of_week"])
    inputs = [*EXOGENOUS, "value_peak", "is_weekend", "month", "day_of_week"]
    found = profile.feature_correlations(joined, inputs, [TARGET], SERIES)
    return top_importance(found.select(
        F.col("series").alias("model"), "feature", F.round(F.abs(f"correlation_with_{TARGET}"), 9).alias("importance")))


@query
def operational_metrics(spark, folder):
    """Accuracy by regime of the one-day-ahead models."""
    return learn.regime_metrics(ahead(spark, folder, *learn.MODELS)[0], SERIES)


@query
def recursive_forecast(spark, folder):
    """Strict multi-step forecasts of every series by all models."""
    return recursive.strict_recursive(modelled(spark, folder), TARGET, TEST_START, TEST_END, SERIES, "drop")[0]


@query
def recursive_metrics(spark, folder):
    """Accuracy by regime when models see same-day observations but not the target."""
    panel = modelled(spark, folder)
    train, _, columns = learn.model_matrix(panel, TARGET, TEST_START, TEST_END, SERIES)
    fitted = learn.fit_models(train, TARGET, columns, SERIES, store=True)
    forecasts, _ = recursive.strict_recursive(panel, TARGET, TEST_START, TEST_END, SERIES, "actual", fitted=fitted)
    return evaluate.metrics(forecasts, [*SERIES, "demand_regime", "model"])


# Own choice: weights of a linear model that needs no fit, for what SQL can follow day by day.
GIVEN_WEIGHTS = {
    "lag_1": 0.2, "lag_2": 0.05, "lag_7": 0.15, "lag_365": 0.05, "rolling_7_mean": 0.2, "rolling_14_mean": 0.05,
    "rolling_30_mean": 0.15, "rolling_7_max": 0.02, "rolling_30_max": 0.03, "month": 120.0, "is_weekend": -900.0,
    "embedded_solar_capacity_mean": 350.0,
}
GIVEN_INTERCEPT = 9000.0


@query
def recursive_ridge_given(spark, folder):
    """The strict recursion of a linear model with given weights."""
    rows, columns = recursive.panel_rows(modelled(spark, folder), TARGET, TEST_START, TEST_END, SERIES)
    state = recursive.series_state(rows, TARGET, TEST_START, columns, SERIES)
    weights = F.array(F.lit(GIVEN_INTERCEPT), *[F.lit(GIVEN_WEIGHTS.get(c, 0.0)) for c in columns])
    made = recursive.linear_recursion(state.withColumn("_weights", weights), columns)
    return recursive.forecast_rows(made, "given", SERIES).drop("demand_regime")


@query
def boosting_rules(spark, folder):
    """Leaf means and sums of trees of a short boosting run over all training rows."""
    train, _, columns = matrix(spark, folder)
    rows = cut_lineage(learn.tree_matrix(learn.Fitted(TARGET, columns, SERIES), train))
    return learn.boosting_checks(learn.boosted(rows, TARGET, maxIter=20), rows, TARGET)


@query
def holt_winters(spark, folder):
    train, test = sides(stored_orders(spark, folder))
    return smoothing.holt_winters(train, test, TARGET, SERIES)


@query
def forest_rules(spark, folder):
    """Means of trees and label ranges of a short forest over all training rows."""
    train, _, columns = matrix(spark, folder)
    rows = cut_lineage(learn.tree_matrix(learn.Fitted(TARGET, columns, SERIES), train))
    return learn.forest_checks(learn.forest(rows, TARGET, numTrees=20), rows, TARGET)


# Own choice: weights of level, trend and season for what SQL can follow day by day.
GIVEN_SMOOTHING = (0.2, 0.01, 0.1)


@query
def holt_winters_given(spark, folder):
    """Smoothing with trend and season under given weights."""
    train, test = sides(stored_orders(spark, folder))
    return smoothing.smoothed_forecast(train, test, TARGET, GIVEN_SMOOTHING, SERIES)


@query
def level_smoothing(spark, folder):
    train, _ = sides(stored_orders(spark, folder))
    return smoothing.level_smoothing(train, TARGET, 0.2, SERIES)


@query
def sarima(spark, folder):
    train, test = sides(stored_orders(spark, folder))
    return sarimax_.sarima(train, test, TARGET, SERIES)


# Own choice: weights of past values and of past shocks at lags 1, 7 and 8 for what SQL can follow day by day.
GIVEN_ARMA = ((0.3, 0.2, -0.06), (-0.5, -0.4, 0.2))


@query
def sarima_given(spark, folder):
    """Seasonal ARIMA with given weights: shocks of the training days, then forecasts."""
    train, test = sides(stored_orders(spark, folder))
    return sarimax_.sarima_given(train, test, TARGET, *GIVEN_ARMA, SERIES)


@query
def sarima_weights_check(spark, folder):
    """Distance of every estimated weight from least squares, zero to six digits."""
    train, _ = sides(stored_orders(spark, folder))
    return sarimax_.weight_residuals(train, TARGET, SERIES)


@query
def sarimax(spark, folder):
    panel = cut_lineage(add_calendar(daily_joined(spark, folder), only=["month", "day_of_week", "is_weekend"]))
    train, test = sides(panel)
    return sarimax_.sarimax(train, test, TARGET, sarimax_regressors(panel), SERIES)


@query
def adf(spark, folder):
    return stationarity.dickey_fuller(stored_orders(spark, folder), "date", TARGET, SERIES)


@query
def adf_given_lag(spark, folder):
    """The test without lagged moves, which has a closed form."""
    return stationarity.dickey_fuller(stored_orders(spark, folder), "date", TARGET, SERIES, lag=0).select(
        "series", "adf_statistic", "adf_used_lag", "adf_n_obs")


@query
def stationarity_checks(spark, folder):
    return stationarity.stationarity(stored_half_hours(spark, folder), "settlement_datetime", "nd")
