import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterloom.operators import scenario


def context(spark, month="2020-01-15", base=100.0, regime="high", wind=1.0):
    return spark.createDataFrame(
        [(dt.date.fromisoformat(month), base, regime, wind, 0.0, 101.0)],
        "date date, base_forecast double, demand_regime string, embedded_wind_generation_mean double, "
        "embedded_solar_generation_mean double, actual double",
    )


def history(spark):
    return spark.createDataFrame(
        [(dt.date(2019, 1, 1) + dt.timedelta(i), float(i), 0.0) for i in range(9)],
        "date date, embedded_wind_generation_mean double, embedded_solar_generation_mean double",
    )


def uplifts(df):
    return {r.scenario: round(r.scenario_uplift_pct, 10) for r in df.collect()}


def test_combined_uplift_is_capped(spark):
    got = uplifts(scenario.scenario_rows(context(spark), history(spark), "2020-01-01"))
    assert got == {"baseline": 0, "high_demand_stress": 0.05, "low_renewable_stress": 0.02,
                   "winter_peak_stress": 0.07, "combined_stress": 0.12}


def test_no_rule_no_uplift_and_threshold_day_is_low_renewable(spark):
    calm = context(spark, "2020-06-15", regime="normal", wind=2.0)  # first training quartile of 0..8
    assert uplifts(scenario.scenario_rows(calm, history(spark), "2020-01-01"))["low_renewable_stress"] == 0.02
    windy = context(spark, "2020-06-15", regime="normal", wind=2.1)
    assert set(uplifts(scenario.scenario_rows(windy, history(spark), "2020-01-01")).values()) == {0}
    bare = windy.drop("embedded_wind_generation_mean", "embedded_solar_generation_mean")
    assert uplifts(scenario.scenario_rows(bare, history(spark), "2020-01-01"))["low_renewable_stress"] == 0


def pool(spark, residuals=(-1.0, 0.0, 1.0)):
    return spark.createDataFrame(list(enumerate(residuals)), "idx int, residual double")


def rows(spark, adjusted=100.0):
    return spark.createDataFrame(
        [(dt.date(2020, 1, 1), "baseline", adjusted, adjusted, 0.0)],
        "date date, scenario string, base_forecast double, adjusted_forecast double, scenario_uplift_pct double",
    )


def limit(spark, value=100.0):
    return spark.createDataFrame([(value,)], "capacity_threshold double")


def test_exceedance_is_strict(spark):
    got = scenario.exact_exceedance(rows(spark), pool(spark), limit(spark)).first()
    assert got.exceedance_probability == pytest.approx(1 / 3)


def test_bootstrap_approaches_the_exact_share(spark):
    got = scenario.bootstrap(rows(spark), pool(spark), limit(spark), draws=20000).first()
    assert got.exceedance_probability == pytest.approx(1 / 3, abs=0.02)
    assert (got.simulated_p05, got.simulated_p50, got.simulated_p95) == (99, 100, 101)
    assert got.simulated_mean == pytest.approx(100, abs=0.02)


def test_draws_depend_on_nothing_but_their_name(spark):
    many = rows(spark).select(F.explode(F.sequence(F.lit(0), F.lit(50))).alias("i"), "*").withColumn(
        "date", F.date_add("date", F.col("i"))).drop("i")
    once = scenario.bootstrap(many, pool(spark), limit(spark), 50).collect()
    again = scenario.bootstrap(many.repartition(7).orderBy(F.rand()), pool(spark), limit(spark), 50).collect()
    assert sorted(map(str, once)) == sorted(map(str, again))
    other = scenario.bootstrap(many, pool(spark), limit(spark), 50, seed=7).collect()
    assert sorted(map(str, once)) != sorted(map(str, other))


def test_refusals(spark):
    with pytest.raises(ValueError):
        scenario.bootstrap(rows(spark), pool(spark), limit(spark), draws=0)
    with pytest.raises(Exception, match="no residuals"):
        scenario.bootstrap(rows(spark), pool(spark, ()), limit(spark), 5).collect()
    with pytest.raises(KeyError, match="a_forecast"):
        scenario.choose_base(rows(spark).withColumn("a_forecast", F.lit(1)), "b_forecast")
    holes = rows(spark).withColumn("a_forecast", F.lit("x"))
    with pytest.raises(Exception, match="non-numeric"):
        scenario.choose_base(holes, "a_forecast").collect()


def test_no_threshold_means_no_probability(spark):
    assert scenario.bootstrap(rows(spark), pool(spark), None, 10).first().exceedance_probability is None


def test_threshold_may_be_supplied(spark):
    daily = history(spark).withColumn("y", F.col("embedded_wind_generation_mean"))
    row = scenario.capacity_threshold(daily, "y", "2020-01-01").first()
    assert (row.capacity_threshold, row.training_rows, row.training_start) == (pytest.approx(7.6), 9, dt.date(2019, 1, 1))
    row = scenario.capacity_threshold(daily, "y", "2020-01-01", supplied=5).first()
    assert (row.capacity_threshold, row.threshold_source, row.percentile) == (5.0, scenario.SUPPLIED_SOURCE, None)


def test_clashing_context_names_are_kept_apart(spark):
    forecasts = context(spark).select("date", "base_forecast", F.lit("low").alias("demand_regime"), F.lit(9).alias("month"))
    daily = context(spark).withColumn("y", F.lit(3.0))
    row = scenario.add_context(forecasts, daily, "y", "2020-01-01", "2020-12-31").first()
    assert (row.month, row.month_daily, row.demand_regime, row.demand_regime_daily, row.actual) == (9, 1, "low", "high", 3.0)


def test_residuals_are_centred(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 1, d), a, 10.0) for d, a in ((1, 11.0), (2, 13.0), (3, None))],
        "date date, actual double, base_forecast double")
    assert [(r.idx, r.residual) for r in scenario.residual_pool(df).orderBy("idx").collect()] == [(0, -1.0), (1, 1.0)]
