"""Null series keys, numbers that are none, offsets, outliers and sub-second stamps."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.functions.clock import parse_stamp
from meterloom.operators import baseline, daily, learn, profile, quality, regression, scenario
from meterloom.operators.quantiles import exact_quantiles
from meterloom.plans import queries


@pytest.mark.parametrize("parts", [1, 5, 8])
def test_ridge_with_a_constant_and_an_offset(spark, parts):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 400)
    y = 3 * x + rng.normal(0, 0.1, 400)
    rows = [("k" if i % 2 else None, 12.7, float(x[i] + 1e6), float(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, c double, a double, y double").repartition(parts)
    model = regression.ridge(df, "y", ["c", "a"], ["k"])
    got = {r.k: r for r in model.collect()}
    for key, mine in (("k", slice(1, None, 2)), (None, slice(0, None, 2))):
        z = (x[mine] - x[mine].mean()) / x[mine].std()
        want = z @ (y[mine] - y[mine].mean()) / (z @ z + 1)
        assert got[key].scaled_coefficients == pytest.approx([0.0, want], abs=1e-7)
        assert got[key].coefficients[0] == 0.0
    check = regression.ridge_residuals(model, df, "y", ["c", "a"], ["k"]).collect()
    assert len(check) == 4 and all(r.distance < 1e-6 for r in check)
    ranks = [(r.feature, r["rank"]) for r in regression.coefficient_table(model, ["c", "a"], ["k"]).where("k = 'k'").collect()]
    assert sorted(ranks) == [("a", 1), ("c", 2)]


def test_ridge_residuals_notice_a_wrong_model(spark):
    df = spark.range(100).select(F.rand(1).alias("a"), (F.rand(1) * 2 + F.rand(2)).alias("y"))
    model = regression.ridge(df, "y", ["a"]).withColumn("coefficients", F.transform("coefficients", lambda c: c * 1.01))
    assert regression.ridge_residuals(model, df, "y", ["a"]).first().distance > 1e-4


def test_short_series_have_no_coefficients(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 3.0), ("l", 1.0, 0.0, 2.0), ("l", 0.0, 1.0, 5.0), ("l", 1.0, 1.0, 7.0)], "k string, a double, b double, y double")
    got = {r.k: r.coefficients for r in regression.least_squares(df, "y", ["a", "b"], ["k"]).collect()}
    assert got["s"] is None and got["l"] == pytest.approx([2, 5])


def stamps(spark, seconds, key="s"):
    start = dt.datetime(2020, 1, 1, 23, 59, 50)
    return spark.createDataFrame([(key, start + dt.timedelta(seconds=s)) for s in seconds], "k string, t timestamp_ntz")


@pytest.mark.parametrize("step, label", [(1.5, "1.5 s"), (0.5, "0.5 s"), (0.000001, "0.000001 s"), (60.0, "60 s"), (100000.0, "100000 s")])
def test_steps_below_and_above_a_second(spark, step, label):
    times = [i * step for i in range(20)]
    row = quality.step_summary(stamps(spark, times), "t").first()
    assert (row.most_common_seconds, row.frequency) == (pytest.approx(step), label)
    gap = quality.timestamp_gaps(stamps(spark, times[:7] + times[8:], None), "t", ["k"]).collect()
    assert [r.t for r in gap] == [dt.datetime(2020, 1, 1, 23, 59, 50) + dt.timedelta(seconds=times[7])]


def test_histogram_and_quantiles_skip_what_is_no_number(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, math.nan, math.inf, -math.inf, None, 3.0)], "v double")
    got = profile.histogram(df, "v", 2).orderBy("bin").collect()
    assert [(r.bin, r.bin_start, r.rows) for r in got] == [(0, 1.0, 1), (1, 2.0, 2)]
    assert exact_quantiles(df, "v", {"m": 0.5}).first().m == 2.0
    assert profile.density_curve(df, "v", points=3).count() == 3


def test_density_equals_the_exact_kernel_sum(spark):
    x = np.random.default_rng(3).gamma(2, 3, 3000)
    got = profile.density_curve(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", points=9).collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in got:
        want = np.exp(-(((r.x - x) / h) ** 2) / 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("extra", [[], [1e300], [1e300, -1e300, 0.0], [5e-324] * 3])
def test_quantiles_split_until_small(spark, extra):
    rng = np.random.default_rng(6)
    values = np.r_[rng.normal(0, 1e-6, 3000), np.full(2000, 7.5), rng.normal(1e9, 1, 3000), extra]
    rows = [("g" if i % 2 else None, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"], bins=16, coarse=4, most=20).collect()}
    for key in ("g", None):
        mine = [v for k, v in rows if k == key]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(float(np.quantile(mine, p)), rel=1e-12)


def test_null_series_keys_lose_nothing(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(k, day + dt.timedelta(i), float(i)) for k in ("a", None) for i in (0, 1, 3)], "k string, date date, y double")
    dense = {(r.k, r.date.day): r.y for r in daily.densify(df, ["k"]).collect()}
    assert dense == {(k, d): v for k in ("a", None) for d, v in ((1, 0.0), (2, 1.0), (3, None), (4, 3.0))}
    audit = spark.createDataFrame([(k, i, dt.datetime(2020, 1, 1), "2020-01-01") for i, k in enumerate(("a", "a", None, None))],
                                  "k string, ordinal int, settlement_datetime timestamp_ntz, settlement_date string")
    assert quality.audit_duplicates(audit, keys=["k"]).count() == 4
    test = df.withColumn("date", F.date_add("date", 7))
    got = baseline.weekly_naive(df, test, "y", ["k"]).collect()
    assert len(got) == 6 and all(r.weekly_seasonal_naive_forecast == r.actual for r in got)
    aligned = daily.align_to_calendar(df.select("k", "date"), df.withColumnRenamed("y", "x"), ["x"], ["k"])
    assert sorted((str(r.k), r.x) for r in aligned.collect()) == sorted((str(k), float(i)) for k in ("a", None) for i in (0, 1, 3))


def test_free_dates(spark):
    texts = {
        "2019/01/05": "2019-01-05 00:00", "05/01/2019 00:30": "2019-05-01 00:30", "25/01/2019": "2019-01-25 00:00", "20190105": "2019-01-05 00:00",
        "Jan 5, 2019": "2019-01-05 00:00", "5 Jan 2019 13:45:10": "2019-01-05 13:45", "05-JAN-2019": "2019-01-05 00:00", "2019-01-05T07:30:00": "2019-01-05 07:30",
        "2019.1.5": "2019-01-05 00:00", "45/45/2019": None, "text": None, "": None, "2019/01/05 25:00": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_stamp(F.col("t")).alias("s"))
    assert {r.t: r.s and r.s.strftime("%Y-%m-%d %H:%M") for r in df.collect()} == texts
    typed = spark.sql("select timestamp_ntz'2020-01-02 03:04:05' t, date'2020-01-02' d")
    row = typed.select(*[parse_stamp(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema]).first()
    assert (row.t, row.d) == (dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(2020, 1, 2))


def test_exact_mean_refuses_to_lose_decimals(spark):
    df = spark.createDataFrame([(0.125,), (None,)], "v double")
    assert df.agg(daily.exact_mean(F.col("v"), 3)).first()[0] == 0.125
    with pytest.raises(Exception, match="more than 2 decimals"):
        df.agg(daily.exact_mean(F.col("v"), 2)).collect()


def test_fill_of_a_long_series_is_linear(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").alias("date"), F.when(F.col("id") % 1000 == 500, F.col("id").cast("double")).alias("v"))
    row = daily.fill_gaps(df, ["v"], ["k"]).agg(F.min("v"), F.max("v"), F.count_if(F.col("v") == 500.0)).first()
    assert tuple(row) == (500.0, 99500.0, 1500)


def test_strongest_ignores_signs(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", -0.9), ("c", None), ("d", 0.9), ("y", 1.0)], "column string, correlation_with_target double")
    assert profile.strongest(df, 3, ["y"]) == ["b", "d", "a"]


def test_train_pool(spark):
    context = spark.createDataFrame([("2020-01-01", 5.0, 3.0)], "date string, actual double, base_forecast double")
    train = spark.createDataFrame([("2019-01-01", 5.0, 4.0), ("2019-01-02", 5.0, 1.0)], "date string, actual double, base_forecast double")
    assert sorted(r.residual for r in scenario.residual_pool(context, pool="train", train=train).collect()) == [-1.5, 1.5]
    with pytest.raises(ValueError):
        scenario.residual_pool(context, pool="train")


def test_panel_trees_keep_series_apart(spark):
    day = dt.date(2018, 1, 1)
    rows = [(k, day + dt.timedelta(i), base + size * math.sin(2 * math.pi * i / 7)) for k, base, size in (("a", 10.0, 1.0), ("b", 1e6, 1e5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, date date, y double")
    made, fitted = learn.one_day_ahead(df, "y", "2019-03-01", "2019-12-31", ["k"], ["random_forest"], {"random_forest": {"numTrees": 10}})
    error = {r.k: r.e for r in made.groupBy("k").agg(F.avg(F.abs(F.col("actual") - F.col("random_forest_forecast"))).alias("e")).collect()}
    assert error["a"] < 0.3 and error["b"] < 3e4
    assert fitted.tree_columns[-1] == learn.SERIES_CODE


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pattern_means", "bootstrap_exact", "leakage_check", "fill_exog", "yearly_union", "corr_ranked", "seasonal_naive", "decompose"])
def test_plans_have_no_cross_join(spark, folder, name):
    plan = physical(queries.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans(spark, folder):
    assert physical(queries.QUERIES["yearly_union"](spark, folder)).count("FileScan") == 2
    pool_rows = physical(queries.QUERIES["bootstrap_daily"](spark, folder))
    assert "CartesianProduct" not in pool_rows
