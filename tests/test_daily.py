import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterloom.operators import baseline, daily, evaluate, features


def series(spark, values, first="2020-01-01", key=None):
    day = dt.date.fromisoformat(first)
    rows = [(key or "a", day + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, date date, y double")


def ordered(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("date").collect()]


def test_fill_forward_then_backward_then_zero(spark):
    filled = daily.fill_gaps(series(spark, [None, 2, None, 4, None]), ["y"], ["k"])
    assert ordered(filled, "y") == [2, 2, 2, 4, 4]
    assert ordered(daily.fill_gaps(series(spark, [None, None]), ["y"], ["k"]), "y") == [0, 0]


def test_rolling_uses_earlier_days_only(spark):
    got = features.history_features(series(spark, [1, 2, 3, 4, 5]), "y", ["k"])
    assert ordered(got, "rolling_7_mean") == [None, None, None, 2.0, 2.5]
    assert ordered(got, "lag_1") == [None, 1, 2, 3, 4]


def test_lags_by_row_and_by_day(spark):
    df = series(spark, [1, 2, 3, 4]).where("date <> '2020-01-03'")
    assert ordered(features.history_features(df, "y", ["k"]), "lag_1")[-1] == 2
    assert ordered(features.history_features(df, "y", ["k"], mode="calendar"), "lag_1")[-1] is None
    split = features.history_features(df, "y", ["k"], mode="calendar", block=400)
    assert ordered(split, "lag_1") == [None, 1, None]
    with pytest.raises(ValueError):
        features.history_features(df, "y", ["k"], mode="hours")


def test_future_values_never_change_features(spark):
    values = list(range(1, 60))
    changed = values[:40] + [v * 100 for v in values[40:]]
    columns = [*[f"lag_{k}" for k in features.LAGS], *features.ROLLING]
    a, b = (ordered(features.history_features(series(spark, v), "y", ["k"]), *columns) for v in (values, changed))
    assert a[:41] == b[:41]
    assert a[41] != b[41]


def test_leakage_check_notices_a_peeking_feature(spark):
    good = features.history_features(series(spark, range(1, 80)), "y", ["k"])
    assert {r.mismatches for r in features.leakage_check(good, "y", ["k"]).collect()} == {0}
    bad = good.withColumn("rolling_7_max", F.greatest("rolling_7_max", "y"))
    found = {r.feature: r.mismatches for r in features.leakage_check(bad, "y", ["k"]).collect()}
    assert found.pop("rolling_7_max") > 0 and set(found.values()) == {0}


def test_leakage_check_beyond_one_part(spark):
    values = [None if i % 11 == 3 else float(i * i % 97) for i in range(900)]
    rows = series(spark, values).unionByName(series(spark, values[:366]).withColumn("k", F.lit(None).cast("string")))
    good = features.history_features(rows, "y", ["k"])
    found = features.leakage_check(good, "y", ["k"]).collect()
    assert {r.mismatches for r in found} == {0}
    assert {r.feature: r.rows_checked for r in found} == {c: good.where(F.col(c).isNotNull()).count() for c in [*[f"lag_{k}" for k in features.LAGS], *features.ROLLING]}
    # One wrong value on each side of a part's border, a null where a value belongs, and a value where none does.
    day = F.col("date")
    dates = [r.date for r in good.where("k is not null").orderBy("date").select("date").collect()]
    at = lambda i: day.eqNullSafe(F.lit(dates[i])) & F.col("k").isNotNull()
    bad = good.withColumn("lag_365", F.when(at(730) | at(729), -1.0).otherwise(F.col("lag_365"))).withColumn(
        "rolling_30_mean", F.when(at(400), None).when(at(2), 5.0).otherwise(F.col("rolling_30_mean")))
    found = {r.feature: r.mismatches for r in features.leakage_check(bad, "y", ["k"]).collect() if r.mismatches}
    assert found == {"lag_365": 2, "rolling_30_mean": 2}


def test_regimes_differ_at_their_boundaries(spark):
    train = series(spark, [1, 2, 3, 4], "2019-01-01")
    probe = series(spark, [1.75, 3.25, 1, 4, None], "2020-01-01")
    got = features.training_regime(train.union(probe), "y", "2020-01-01", ["k"]).where("date >= '2020-01-01'")
    assert ordered(got, "demand_regime") == ["normal", "normal", "low", "high", "normal"]
    # inclusive: five values whose quartiles are themselves evaluated values
    actuals = series(spark, [1, 2, 3, 4, 5]).withColumnRenamed("y", "actual")
    assert ordered(features.evaluation_regime(actuals, "actual", ["k"]), "demand_regime") == [
        "low", "low", "normal", "high", "high"]


def test_seasonal_naive_and_leap_day(spark):
    train = series(spark, range(800), "2022-11-01")  # to 2025-01-08
    train = train.where("date <= '2024-12-31'")
    value = {r.date: r.y for r in train.collect()}
    test = series(spark, [0] * 60, "2025-02-01")
    got = {r.date: r.seasonal_naive_forecast for r in baseline.seasonal_naive(train, test, "y", ["k"]).collect()}
    assert got[dt.date(2025, 2, 28)] == value[dt.date(2024, 2, 28)]
    early = train.where("date < '2024-02-01'")
    leap = series(spark, [0], "2024-02-29")
    assert baseline.seasonal_naive(early, leap, "y", ["k"]).first()[-1] == value[dt.date(2023, 2, 28)]


def test_seasonal_naive_tiers(spark):
    # 2024-12-31 is missing, 2025-12-31 minus 365 days is the same day, so the last value remains
    train = series(spark, range(100), "2024-09-01").where("date <> '2024-11-05'")
    test = series(spark, [0], "2025-11-05")
    assert baseline.seasonal_naive(train, test, "y", ["k"]).first()[-1] == 99
    # after a leap day the calendar year is 366 days, so 365 days back is a different day
    train = series(spark, [5, 6], "2024-01-09")
    test = series(spark, [0], "2025-01-09")
    assert baseline.seasonal_naive(train.where("date <> '2024-01-09'"), test, "y", ["k"]).first()[-1] == 6
    strict = baseline.seasonal_naive(train.where("date <> '2024-01-09'"), test, "y", ["k"], use_365=False)
    assert strict.first()[-1] == 6  # the last training value, by the other route


def test_weekly_naive_is_flat_after_one_week(spark):
    train, test = series(spark, range(10)), series(spark, [0] * 10, "2020-01-11")
    assert ordered(baseline.weekly_naive(train, test, "y", ["k"]), "weekly_seasonal_naive_forecast") == [
        3, 4, 5, 6, 7, 8, 9, 9, 9, 9]


def test_metrics_skip_zero_actuals_in_mape_only(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 10.0, 8.0), ("m", 20.0, 25.0)], "model string, actual double, forecast double")
    row = evaluate.metrics(df, ["model"]).first()
    assert row.mae == pytest.approx(8 / 3) and row.rmse == pytest.approx(10**0.5) and row.mape == pytest.approx(22.5)


def test_later_tables_win_and_columns_may_be_missing(spark):
    a = spark.createDataFrame([("m", 1.0, 2.0), ("n", 3.0, 4.0)], "model string, mae double, rmse double")
    b = spark.createDataFrame([("m", 9.0)], "model string, mae double")
    got = {r.model: (r.mae, r.rmse) for r in evaluate.metrics_union(a, b).collect()}
    assert got == {"m": (9.0, None), "n": (3.0, 4.0)}
    first = evaluate.keep_by_priority(evaluate.stacked(a, b), ["model"], last=False)
    assert {r.model: r.mae for r in first.collect()} == {"m": 1.0, "n": 3.0}


def test_split_refuses_an_empty_side(spark):
    df = series(spark, range(10))
    with pytest.raises(ValueError, match="training"):
        daily.time_split(df, "2019-01-01", "2020-12-31", "y")
    with pytest.raises(ValueError, match="test"):
        daily.time_split(df, "2021-01-01", "2021-12-31", "y")


def test_zero_spread_scales_by_one(spark):
    df = series(spark, [4, 4, 4])
    assert ordered(daily.standardise(df, df, ["y"], ["k"]), "y") == [0, 0, 0]


def test_availability_rules():
    kinds = {c: features.availability_class(c) for c in (
        "lag_7", "lag_x", "rolling_7_mean", "is_weekend", "embedded_solar_capacity_mean", "ifa_flow_mean", "price")}
    assert kinds == {
        "lag_7": "target lag", "lag_x": "other", "rolling_7_mean": "rolling target history", "is_weekend": "calendar",
        "embedded_solar_capacity_mean": "capacity variable", "ifa_flow_mean": "observed exogenous variable", "price": "other"}
    assert features.strict_columns(["ifa_flow_mean", "embedded_wind_capacity_mean", "lag_1"]) == ["embedded_wind_capacity_mean", "lag_1"]
    with pytest.raises(ValueError):
        features.strict_columns([], "maybe")


def test_error_slices_equal_separate_groupings(spark):
    wide = series(spark, [i % 13 for i in range(200)]).select(
        "k", "date", F.col("y").alias("actual"), (F.col("y") + F.rand(3)).alias("a_forecast"), F.lit(5.0).alias("naive_forecast"))
    errors = evaluate.with_errors(evaluate.long_forecasts(wide, ["k"]))
    got = evaluate.error_slices(errors, ["k"]).where("slice = 'demand_regime'")
    want = evaluate.period_columns(errors, ["k"]).groupBy("model", "demand_regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("absolute_error").alias("m"), F.avg("absolute_percentage_error").alias("p"))
    pairs = got.join(want, (got.model == want.model) & (got.slice_value == want.demand_regime)).collect()
    assert len(pairs) == 6
    for r in pairs:
        assert r.rows == r.n and r.mae == pytest.approx(r.m) and r.mape == pytest.approx(r.p)


def test_correlation_of_a_constant_is_null(spark):
    from meterloom.functions.stats import pearson

    df = spark.createDataFrame([(1.0, 5.0, -1.0), (2.0, 5.0, -2.0), (4.0, 5.0, -4.0), (None, 5.0, 3.0)], "a double, b double, c double")
    row = df.agg(pearson("a", "b").alias("x"), pearson("b", "a").alias("y"), pearson("a", "c").alias("z")).first()
    assert (row.x, row.y, row.z) == (None, None, pytest.approx(-1))
