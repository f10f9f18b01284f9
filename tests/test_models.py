import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from meterloom.operators import features, learn, profile, recursive, regression, sarimax, smoothing, stationarity
from meterloom.operators.learn import assemble
from meterloom.session import cut_lineage


def table(spark, values, first="2018-01-01", key="a"):
    day = dt.date.fromisoformat(first)
    return spark.createDataFrame(
        [(key, day + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "k string, date date, y double")


@pytest.fixture(scope="module")
def seasonal():
    rng = np.random.default_rng(0)
    t = np.arange(900)
    return 100 + 0.02 * t + 15 * np.sin(2 * np.pi * t / 365) + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, t.size)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, [1, 30, 0.01], (300, 3))
    y = x @ [2.0, -0.1, 40.0] + rng.normal(0, 1, 300)
    df = spark.createDataFrame([("ab"[i % 3 == 0], *map(float, x[i]), float(y[i])) for i in range(300)], "k string, a double, b double, c double, y double")
    got = {r.k: r for r in regression.ridge(df.repartition(5), "y", ["a", "b", "c"], ["k"], 1.0).collect()}
    for key, mine in (("b", np.arange(300) % 3 == 0), ("a", np.arange(300) % 3 != 0)):
        z = (x[mine] - x[mine].mean(0)) / x[mine].std(0)
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[mine] - y[mine].mean()))
        assert got[key].scaled_coefficients == pytest.approx(list(w), rel=1e-6)
        plain = w / x[mine].std(0)
        assert got[key].intercept == pytest.approx(y[mine].mean() - plain @ x[mine].mean(0), rel=1e-6)
    fitted = regression.predict_linear(df, regression.ridge(df, "y", ["a", "b", "c"], ["k"]), ["a", "b", "c"], ["k"], "p")
    assert fitted.agg(F.corr("y", "p")).first()[0] > 0.9


def boost_rows(spark):
    df = spark.range(400).select(F.rand(1).alias("a"), F.randn(2).alias("b"), (F.col("id") % 7).cast("double").alias("c"))
    return assemble(df.withColumn("y", F.col("a") * 3 + F.col("b") * F.col("c") + 50), ["a", "b", "c"]).select("features", "y")


def test_boosting_starts_from_the_mean_and_shrinks_every_tree(spark):
    rows = cut_lineage(boost_rows(spark))
    model = learn.boosted(rows, "y", maxIter=12, stepSize=0.1)
    assert model.treeWeights == [1.0] + [0.1] * 12 and model.trees[0].depth == 0
    y = np.array([r.y for r in rows.collect()])
    assert model.trees[0].predict(rows.first().features) == pytest.approx(y.mean())
    checked = {r.rule: r for r in learn.boosting_checks(model, rows, "y").collect()}
    assert checked["leaf means"].rows == 400 * 13 and checked["leaf means"].mismatches == 0
    assert checked["sum of trees"].rows == 400 and checked["sum of trees"].mismatches == 0
    # The rules tell a model of other labels.
    other = {r.rule: r.mismatches for r in learn.boosting_checks(model, rows.withColumn("y", F.col("y") + 1), "y").collect()}
    assert other["leaf means"] == 400 * 13
    error = [np.mean([(r.y - r.p) ** 2 for r in learn.boosted(rows, "y", maxIter=n).setPredictionCol("p").transform(rows).collect()]) for n in (1, 15)]
    assert error[1] < error[0] < y.var()


def test_model_store_knows_rows_and_settings(spark):
    rows = cut_lineage(boost_rows(spark))
    first = learn.tree_model("gradient_boosting", rows, "y", True, maxIter=2)
    again = learn.tree_model("gradient_boosting", rows.repartition(5), "y", True, maxIter=2)
    assert again.uid == first.uid and again.treeWeights == first.treeWeights
    predicted = lambda m: [r.p for r in m.setPredictionCol("p").transform(rows).orderBy("y").collect()]
    assert predicted(first) == predicted(again)
    assert len(again.featureImportances) == 3
    assert learn.tree_model("gradient_boosting", rows, "y", True, maxIter=3).getNumTrees == 4
    other = learn.tree_model("gradient_boosting", rows.withColumn("y", F.col("y") + 1), "y", True, maxIter=2)
    assert other.trees[0].predict(rows.first().features) == pytest.approx(first.trees[0].predict(rows.first().features) + 1)
    with pytest.raises(ValueError):
        learn.tree_model("no such", rows, "y")


def replay(past, known, columns, fill, predict):
    """The recursion written out: history as a list, one day after the other."""
    history, made = list(past), []
    for day in known:
        x = []
        for i, c in enumerate(columns):
            v = day[i]
            if c.startswith("lag_"):
                k = int(c[4:])
                v = history[-k] if len(history) >= k else None
            elif c in features.ROLLING:
                statistic, length, fewest = features.ROLLING[c]
                part = history[-length:]
                v = None if len(part) < fewest else max(part) if statistic == "max" else sum(part) / len(part)
            x.append(fill[i] if v is None else v)
        made.append(predict(x))
        history.append(made[-1])
    return made


def test_recursion_equals_a_replay(spark, seasonal):
    cut = 760
    start = (dt.date(2018, 1, 1) + dt.timedelta(cut)).isoformat()
    df = table(spark, seasonal[:775]).union(table(spark, seasonal[5:770] * 2, key="b"))
    settings = {"gradient_boosting": {"maxIter": 4}, "random_forest": {"numTrees": 3, "maxDepth": 4}}
    forecasts, fitted = recursive.strict_recursive(df, "y", start, "2030-01-01", ["k"], settings=settings)
    got = {(r.k, r.model): [] for r in forecasts.select("k", "model").distinct().collect()}
    for r in forecasts.orderBy("date").collect():
        got[r.k, r.model].append(r.forecast)
    rows, columns = recursive.panel_rows(df, "y", start, "2030-01-01", ["k"])
    scales = {r.k: r for r in fitted.scales.collect()}
    ridge = {r.k: r for r in fitted.ridge.collect()}
    for s in recursive.series_state(rows, "y", start, columns, ["k"]).collect():
        known = [d.known for d in s._days]
        weights = ridge[s.k]
        line = lambda x: weights.intercept + np.dot(weights.coefficients, x)  # noqa: B023, E731
        assert got[s.k, "ridge"] == pytest.approx(replay(s._history, known, columns, s._fill, line), rel=1e-9)
        unit = scales[s.k]
        for name, model in fitted.trees.items():
            def predict(x, model=model, unit=unit):
                scaled = [(v - unit._mu) / unit._sd if learn.is_history(c) else v for v, c in zip(x, columns, strict=True)]
                return unit._mu + unit._sd * model.predict(Vectors.dense([*scaled, unit[learn.SERIES_CODE]]))

            assert got[s.k, name] == pytest.approx(replay(s._history, known, columns, s._fill, predict), rel=1e-9)
    assert {len(v) for v in got.values()} == {5, 15}


def test_recursion_never_sees_test_targets(spark, seasonal):
    values = seasonal[:800]
    cut = 760
    other = np.concatenate([values[:cut], values[cut:] * 3])
    start = (dt.date(2018, 1, 1) + dt.timedelta(cut)).isoformat()
    runs = []
    for v in (values, other):
        forecasts, _ = recursive.strict_recursive(
            table(spark, v), "y", start, "2030-01-01", ["k"], "drop", ["ridge", "gradient_boosting"],
            {"gradient_boosting": {"maxIter": 3}})
        runs.append({(r.model, r.date): r for r in forecasts.collect()})
    assert len(runs[0]) == 80
    for key, r in runs[0].items():
        assert r.forecast == pytest.approx(runs[1][key].forecast, rel=1e-9)
    ridge = [r for (m, _), r in runs[0].items() if m == "ridge"]
    naive = np.mean([abs(r.actual - values[cut - 1]) for r in ridge])
    assert np.mean([abs(r.actual - r.forecast) for r in ridge]) < naive


def test_first_recursive_step_equals_one_day_ahead(spark, seasonal):
    cut = 760
    start = (dt.date(2018, 1, 1) + dt.timedelta(cut)).isoformat()
    df = table(spark, seasonal[:780])
    strict, _ = recursive.strict_recursive(df, "y", start, "2030-01-01", ["k"], models=["ridge"])
    ahead, fitted = learn.one_day_ahead(df, "y", start, "2030-01-01", ["k"], ["ridge"])
    a, b = strict.orderBy("date").first(), ahead.orderBy("date").first()
    assert a.forecast == pytest.approx(b.ridge_forecast, rel=1e-9)
    assert learn.ridge_coefficients(fitted).count() == len(fitted.columns)


def smooth_by_hand(y, alpha, beta, gamma, season):
    cycles = [[v for v in y[i * season:(i + 1) * season] if v is not None] for i in range(2)]
    level, drift = np.mean(cycles[0]), (np.mean(cycles[1]) - np.mean(cycles[0])) / season
    waves = [0.0 if v is None else v - level for v in y[:season]]
    for t, v in enumerate(y):
        ahead, wave = level + drift, waves[t % season]
        error = 0.0 if v is None else v - ahead - wave
        level, drift, waves[t % season] = ahead + alpha * error, drift + alpha * beta * error, wave + gamma * (1 - alpha) * error
    return lambda h: level + drift * h + waves[(len(y) + h - 1) % season]


@pytest.mark.parametrize("season, days", [(7, 61), (20, 40), (21, 100), (2, 9)])
def test_smoothing_fold_equals_a_loop(spark, season, days):
    rng = np.random.default_rng(season)
    y = [float(v) for v in 50 + np.arange(days) * 0.3 + rng.normal(0, 3, days)]
    for i in (0, 5, days // 2):
        y[i] = None
    y[-1] = 47.0
    first = dt.date(2018, 1, 1)
    rows = [("a", first + dt.timedelta(i), v) for i, v in enumerate(y) if v is not None or i == 0]
    train = spark.createDataFrame(rows, "k string, date date, y double")
    test = spark.createDataFrame([("a", first + dt.timedelta(days + h), 1.0) for h in range(30)] + [("new", first, 1.0)], "k string, date date, y double")
    want = smooth_by_hand(y, 0.3, 0.1, 0.2, season)
    got = smoothing.smoothed_forecast(train, test, "y", (0.3, 0.1, 0.2), ["k"], season).orderBy("k", "date").collect()
    assert [r.holt_winters_forecast for r in got[:30]] == pytest.approx([want(h + 1) for h in range(30)], rel=1e-12)
    assert got[30].holt_winters_forecast is None


def test_smoothing_forms_and_their_fall_back(spark):
    rows = [("long", v, i) for i, v in enumerate(np.sin(np.arange(740)) + 5)] + [("mid", 2.0 * i, i) for i in range(25)] + [("few", 3.0, i) for i in range(4)]
    first = dt.date(2018, 1, 1)
    train = spark.createDataFrame([(k, first + dt.timedelta(i), float(v)) for k, v, i in rows] + [("none", first, None)], "k string, date date, y double")
    test = spark.createDataFrame([(k, dt.date(2020, 6, 1), 0.0) for k in ("long", "mid", "few", "none")], "k string, date date, y double")
    got = {r.k: r for r in smoothing.holt_winters(train, test, "y", ["k"]).collect()}
    assert {k: r.holt_winters_form for k, r in got.items()} == {
        "long": "trend and season", "mid": "trend", "few": "level", "none": "last value"}
    assert got["few"].holt_winters_forecast == pytest.approx(3.0) and got["none"].holt_winters_forecast is None
    steps = (dt.date(2020, 6, 1) - first).days
    assert got["mid"].holt_winters_forecast == pytest.approx(2.0 * steps, rel=0.05)


def test_given_arima_weights_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    y = list(np.cumsum(rng.normal(0, 1, 60)) + 30)
    ar, ma = (0.4, 0.1, -0.05), (-0.3, -0.2, 0.1)
    w = [y[t] - y[t - 1] - y[t - 7] + y[t - 8] for t in range(8, 60)]
    e = []
    term = lambda seq, k, t: seq[t - k] if t >= k else 0.0
    for t, v in enumerate(w):
        e.append(v - sum(a * term(w, k, t) + m * term(e, k, t) for a, m, k in zip(ar, ma, (1, 7, 8), strict=True)))
    z = list(y)
    for _ in range(15):
        t = len(w)
        w.append(sum(a * term(w, k, t) + m * term(e, k, t) for a, m, k in zip(ar, ma, (1, 7, 8), strict=True)))
        e.append(0.0)
        z.append(w[-1] + z[-1] + z[-7] - z[-8])
    df = table(spark, z)
    train, test = df.where(F.col("date") < "2018-03-02"), df.where(F.col("date") >= "2018-03-02")
    assert train.count() == 60
    got = sarimax.sarima_given(train, test, "y", ar, ma, ["k"]).orderBy("date").collect()
    assert [r.sarima_forecast for r in got] == pytest.approx(z[60:], rel=1e-9)
    short = sarimax.sarima_given(train.limit(5), test, "y", ar, ma, ["k"]).collect()
    assert {r.sarima_forecast for r in short} == {None}


def test_smoothing_follows_trend_and_season(spark, seasonal):
    df = table(spark, seasonal)
    train, test = df.where("date < '2020-04-01'"), df.where("date >= '2020-04-01'")
    got = smoothing.holt_winters(train, test, "y", ["k"]).collect()
    last = train.orderBy(F.col("date").desc()).first().y
    assert np.mean([abs(r.actual - r.holt_winters_forecast) for r in got]) < 0.7 * np.mean([abs(r.actual - last) for r in got])
    short = smoothing.holt_winters(table(spark, [3, 3, 3]), table(spark, [4], "2018-01-05"), "y", ["k"]).first()
    assert short.holt_winters_forecast == pytest.approx(3)
    levels = smoothing.level_smoothing(table(spark, [1, 2, 3]), "y", 0.5, ["k"]).first()
    assert levels.level == pytest.approx(2.25)


def test_seasonal_arima_beats_naive(spark):
    rng = np.random.default_rng(3)
    wave = np.array([0, 3, 5, 4, 2, -6, -8.0])
    noise = np.zeros(700)
    for t in range(1, 700):
        noise[t] = 0.5 * noise[t - 1] + rng.normal(0, 0.5)
    x = rng.normal(0, 1, 700)
    y = 50 + wave[np.arange(700) % 7] + noise + 4 * x
    df = table(spark, y).withColumn("i", F.datediff("date", F.lit("2018-01-01")))
    df = df.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double"), "i").drop("i")
    train, test = df.where("date < '2019-11-01'"), df.where("date >= '2019-11-01'")
    plain = {r.date: r for r in sarimax.sarima(train, test, "y", ["k"]).collect()}
    full = {r.date: r for r in sarimax.sarimax(train, test, "y", ["x"], ["k"]).collect()}
    last = train.orderBy(F.col("date").desc()).first().y
    naive = np.mean([abs(r.actual - last) for r in plain.values()])
    error = np.mean([abs(r.actual - r.sarima_forecast) for r in plain.values()])
    better = np.mean([abs(r.actual - r.sarimax_forecast) for r in full.values()])
    assert len(plain) == len(full) == test.count()
    assert error < naive and better < 0.5 * error
    same = sarimax.sarimax(train, test, "y", [], ["k"]).first()
    assert same.sarimax_forecast == pytest.approx(plain[same.date].sarima_forecast)


def brute_force_test(y):
    """Constant-only augmented Dickey-Fuller with AIC lag choice on one array."""
    n = len(y)
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    move = np.diff(y)

    def regress(lag, first):
        rows = np.arange(first, len(move))
        x = np.column_stack([np.ones(len(rows)), y[rows], *[move[rows - k] for k in range(1, lag + 1)]])
        w, *_ = np.linalg.lstsq(x, move[rows], rcond=None)
        rest = ((move[rows] - x @ w) ** 2).sum()
        inv = np.linalg.inv(x.T @ x)
        m = len(rows)
        aic = m * (math.log(2 * math.pi) + math.log(rest / m) + 1) + 2 * (lag + 2)
        return aic, w[1] / math.sqrt(rest / (m - lag - 2) * inv[1, 1]), m

    aic, lag = min((regress(k, most)[0], k) for k in range(most + 1))
    return (regress(lag, lag)[1], lag, regress(lag, lag)[2], aic)


def test_stationarity_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(0, 1, 400)) + 1000
    wave = np.zeros(150)
    for t in range(2, 150):
        wave[t] = 0.6 * wave[t - 1] - 0.3 * wave[t - 2] + rng.normal()
    df = table(spark, walk).union(table(spark, wave, key="b")).union(table(spark, wave[:10], key="short"))
    got = {r.k: r for r in stationarity.dickey_fuller(df, "date", "y", ["k"], block=100).collect()}
    assert set(got) == {"a", "b"}
    for key, y in (("a", walk), ("b", wave)):
        statistic, lag, rows, aic = brute_force_test(y)
        assert (got[key].adf_used_lag, got[key].adf_n_obs) == (lag, rows)
        assert got[key].adf_statistic == pytest.approx(statistic, rel=1e-6)
        assert got[key].adf_icbest == pytest.approx(aic, rel=1e-9)
    assert got["b"].rejects_at_1pct and not got["a"].rejects_at_10pct


def test_decomposition_parts_sum_to_the_series(spark, seasonal):
    df = table(spark, seasonal[:200]).union(table(spark, seasonal[:10], key="short"))
    parts = profile.decompose(df, "date", "y", 7, ["k"], block=40)
    wrong = parts.where("abs(observed - trend - seasonal - residual) > 1e-9 or trend is null")
    assert parts.count() == 200 and wrong.count() == 0
    assert parts.select("seasonal").distinct().count() <= 14
    assert profile.decomposition_period(95) == 7 and profile.decomposition_period(96) == 48
    assert profile.decomposition_period(13) is None


def test_rolling_window_rule(spark, seasonal):
    got = profile.rolling_statistics(table(spark, seasonal[:100]), "date", "y", keys=["k"], block=50).orderBy("date").collect()
    assert got[0].rolling_window == 5 and got[3].rolling_mean is None
    assert got[60].rolling_mean == pytest.approx(seasonal[56:61].mean())
    assert got[60].rolling_std == pytest.approx(seasonal[56:61].std(ddof=1))
