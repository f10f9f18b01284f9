"""Operators on series that no single task should hold, against plain windows on the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterloom.operators import daily, evaluate, features, quality
from meterloom.plans.queries import by_month


def rows(seed, n=400, keys=("a", "b", None)):
    rng = random.Random(seed)
    out = []
    for k in keys:
        at = dt.datetime(2020, 1, 30)
        for _ in range(n):
            at += dt.timedelta(minutes=30 * rng.choice([1, 1, 1, 2, 700 if rng.random() < 0.05 else 1]))
            out.append((k, at, rng.gauss(0, 1) if rng.random() < 0.4 else None, None if k == "b" else rng.gauss(5, 1)))
    return out


@pytest.fixture(scope="module")
def half_hours(spark):
    return spark.createDataFrame(rows(1), "k string, at timestamp_ntz, x double, y double").repartition(5)


def same(a, b, *order):
    first, second = a.orderBy(*order).collect(), b.select(*a.columns).orderBy(*order).collect()
    assert len(first) == len(second)
    for r, s in zip(first, second, strict=True):
        assert tuple(r) == pytest.approx(tuple(s), rel=1e-12) if all(v is None or isinstance(v, float) for v in r) else list(map(str, r)) == list(map(str, s))


@pytest.mark.parametrize("rule", ["year(at) * 12 + month(at)", "1", "unix_seconds(cast(at as timestamp))"])
def test_two_level_fill_equals_one_window(half_hours, rule):
    bucket = F.expr(rule)
    plain = daily.fill_gaps(half_hours, ["x", "y"], ["k"], "at")
    same(plain, daily.fill_gaps(half_hours, ["x", "y"], ["k"], "at", bucket), "k", "at")
    assert plain.where("k = 'b' and y <> 0").isEmpty()


def test_two_level_fill_without_rows(spark, half_hours):
    assert daily.fill_gaps(half_hours.where("false"), ["x"], ["k"], "at", by_month("at")).count() == 0


@pytest.mark.parametrize("block", [365, 400, 5000])
def test_history_in_row_blocks_equals_one_window(half_hours, block):
    known = half_hours.withColumn("y", F.coalesce("y", F.lit(1.0)))
    plain = features.history_features(known, "y", ["k"], order="at")
    cut = features.history_features(known, "y", ["k"], block=block, order="at", bucket=by_month("at"))
    names = [f"lag_{k}" for k in features.LAGS] + list(features.ROLLING)
    near = lambda df: df.select("k", "at", *[F.round(c, 9).alias(c) for c in names])
    same(near(plain), near(cut), "k", "at")


def test_blocks_shorter_than_the_longest_lag(half_hours):
    with pytest.raises(ValueError):
        features.history_features(half_hours, "y", ["k"], block=100, order="at", bucket=by_month("at"))


def test_feature_frame_in_blocks(spark):
    first = dt.date(2018, 1, 1)
    df = spark.createDataFrame([(k, first + dt.timedelta(i), float(i % 17 + len(k))) for k in ("a", "bb") for i in range(900)], "k string, date date, y double")
    plain, cut = (features.feature_frame(df, "y", "2020-01-01", ["k"], block=b) for b in (None, 370))
    same(plain, cut, "k", "date")


@pytest.mark.parametrize("block", [7, 50])
def test_autocorrelation_in_blocks_equals_one_window(spark, block):
    rng = random.Random(3)
    data = [(k, m, dt.datetime(2021, 1, 1) + dt.timedelta(minutes=30 * i), rng.gauss(0, 1) + (i % 5), None if i % 11 == 0 else 1.0)
            for k in ("a", None) for m in ("p", "q") for i in range(300)]
    data += [("c", "p", dt.datetime(2021, 1, 1), 1.0, 1.0)]
    df = spark.createDataFrame(data, "k string, model string, at timestamp_ntz, e double, keep double").withColumn("error", F.col("e") * F.col("keep"))
    plain = evaluate.residual_autocorrelation(df, ["k"], 7, "at")
    cut = evaluate.residual_autocorrelation(df, ["k"], 7, "at", F.unix_date(F.col("at").cast("date")), block)
    near = lambda d: d.withColumn("autocorrelation", F.round("autocorrelation", 9))
    same(near(plain), near(cut), "k", "model", "lag")


def test_sketches_merge_and_keep_their_bounds(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 5).alias("part"), (F.col("id") % 6000).alias("few"), F.when(F.col("id") % 3 > 0, F.rand(5)).alias("share"),
        F.concat(F.lit("t"), F.col("id") % 20_000).alias("text"))
    columns, probs = ["few", "share", "text"], {"low": 0.1, "mid": 0.5, "top": 0.99}
    parts = quality.sketches(df, columns, ["part"])
    got = {r.column: r for r in quality.sketch_profile(quality.merged_sketches(parts), columns, probs).collect()}
    assert {c: r.non_null_count for c, r in got.items()} == {"few": 60_000, "share": 40_000, "text": 60_000}
    assert got["share"].missing_count == 20_000
    for c, n in (("few", 6000), ("share", 40_000), ("text", 20_000)):
        assert abs(got[c].unique_estimate - n) < 0.08 * n
    for name, p in probs.items():
        assert abs(got["share"][name] - p) < 0.01
        assert abs(got["few"][name] / 6000 - p) < 0.01
    assert got["text"].low is None
    by_part = quality.sketch_profile(parts, columns, probs, ["part"]).where("column = 'few'").collect()
    assert len(by_part) == 5 and {r.non_null_count for r in by_part} == {12_000}


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = quality.sketch_profile(quality.sketches(df, ["a", "b"]), ["a", "b"], {"mid": 0.5}).collect()
    assert [(r.non_null_count, r.unique_estimate, r.mid) for r in got] == [(0, 0, None), (0, 0, None)]


def test_datetime_columns_in_one_job(spark):
    data = [(i, "2020-01-0%d" % (i % 9 + 1), "open" if i % 4 else "2020-02-03", None, None if i < 500 else "2020-03-01", dt.date(2020, 1, 1)) for i in range(2000)]
    df = spark.createDataFrame(data, "n long, day string, some string, none string, late string, d date").repartition(7)
    shares = {r.column: r for r in quality.datetime_shares(df, "n", sample_size=600).collect()}
    assert {c: (r.sampled, r.parsed) for c, r in shares.items()} == {"day": (600, 600), "some": (600, 150), "late": (600, 600)}
    assert quality.detect_datetime_columns(df, 600, ordinal="n") == ["day", "late", "d"]
    assert quality.detect_datetime_columns(df.select("n", "some"), ordinal="n") == []
    assert quality.detect_datetime_columns(df.withColumnRenamed("n", "settlement_datetime"), 600) [0] == "settlement_datetime"
