import pytest
from pyspark.sql import functions as F

from meterloom.plans import stages

START, END = "2021-01-01", "2021-02-28"
QUICK = {"gradient_boosting": {"maxIter": 3}}


@pytest.fixture(scope="module")
def raw(spark):
    """Two years and a bit of half-hourly records with a weekly and yearly shape."""
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2021-02-28')) d")
    halves = days.withColumn("settlement_period", F.explode(F.sequence(F.lit(1), F.lit(48))))
    t, p = F.unix_date("d"), F.col("settlement_period")
    noise = (F.pmod(F.hash("d", "settlement_period"), F.lit(1000)) / 1000 - 0.5) * 400
    return halves.select(
        (t * 100 + p).alias("ordinal"), F.date_format("d", "yyyy-MM-dd").alias("settlement_date"),
        p, F.year("d").alias("source_year"),
        (30000 + 5000 * F.cos(t * 2 * 3.14159 / 365.25) + 1500 * F.sin(t * 2 * 3.14159 / 7) + 2000 * F.sin(p / 8) + noise).alias("nd"),
        (F.pmod(F.hash("d"), F.lit(100)) * 10.0).alias("embedded_wind_generation"),
        F.lit(500.0).alias("embedded_solar_generation"),
    )


@pytest.fixture(scope="module")
def table(raw):
    from meterloom.session import cut_lineage

    return cut_lineage(stages.prepare(raw)["daily"])


def test_prepare(raw, table):
    assert stages.prepare(raw)["duplicate_audit"].count() == 0
    row = table.where("date = '2020-03-29'").first()
    assert (row.settlement_period_count, row.expected_settlement_period_count, row.has_incomplete_day) == (48, 46, False)
    assert table.count() == 790


def test_explore(raw):
    found = stages.explore(raw.where("settlement_date < '2019-03-01'"))
    for name, frame in found.items():
        frame.write.format("noop").mode("overwrite").save()
    assert found["time_steps"].first().frequency == "1800 s"
    assert found["gaps"].isEmpty() and found["stationarity"].count() == 1
    assert found["decomposition"].count() == 59 * 48


def test_forecast_stages(table):
    first = stages.baselines(table, "nd_mean", START, END)
    assert {r.model for r in first["metrics"].collect()} == {"naive", "seasonal_naive", "holt_winters"}
    second = stages.statistical(table, "nd_mean", START, END, earlier=first)
    assert [r.model for r in second["metrics"].orderBy("model_order").collect()] == [
        "naive", "seasonal_naive", "holt_winters", "sarima", "sarimax"]
    assert second["verdicts"].count() == 2
    found = stages.diagnostics(table, second["forecasts"], "nd_mean", START, END, peak="nd_peak")
    assert found["residual_autocorrelation"].count() == 60
    assert found["refined_benchmarks"].count() == 2
    assert found["error_slices"].where("slice = 'month'").count() == 6
    assert found["feature_correlations"].count() == 5
    assert found["incomplete_days"].where("has_incomplete_day").count() == 0


def test_model_stages(table):
    models = ["ridge", "gradient_boosting"]
    made = stages.feature_models(table, "nd_mean", START, END, models=models, settings=QUICK)
    assert made["forecasts"].count() == 59
    checked = stages.validation(table, "nd_mean", START, END, made["metrics"], models=models, settings=QUICK)
    designs = {(r.model, r.forecast_design) for r in checked["design_comparison"].collect()}
    assert designs == {(m, d) for m in models for d in ("operational_one_day_ahead", "strict_recursive_drop_exog")} | {
        ("seasonal_naive", "benchmark")}
    run = stages.scenarios(table, made["forecasts"], "nd_mean", START, END, base="ridge_forecast", draws=50,
                           designs=checked["design_comparison"])
    summary = run["summary"].collect()
    assert len(summary) == 5 and all(r.n_days == 59 for r in summary)
    peak = {r.scenario: r.expected_exceedance_days for r in summary}
    assert peak["combined_stress"] >= peak["winter_peak_stress"] >= peak["baseline"]
    assert "MAPE" in run["method"].first().forecast_validation_context
    with pytest.raises(ValueError):
        stages.scenarios(table, made["forecasts"], "nd_mean", "2030-01-01", "2030-02-01")
