import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom.functions.clock import expected_periods
from meterloom.operators import daily, quality
from meterloom.operators.quantiles import bounded_quantiles, exact_quantiles
from meterloom.operators.series import numbered, own_rows, split_window, with_halo


def clock(spark, first, last):
    """Full settlement clock with one value per period."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) d")
    periods = days.withColumn("settlement_period", F.explode(F.sequence(F.lit(1), expected_periods(F.col("d")))))
    raw = periods.select(
        F.date_format("d", "yyyy-MM-dd").alias("settlement_date"), "settlement_period",
        F.year("d").alias("source_year"), (F.unix_date("d") * 100 + F.col("settlement_period")).alias("ordinal"),
        F.col("settlement_period").cast("double").alias("nd"),
    )
    return quality.add_stamp(raw)


def test_seven_year_clock_reproduces_the_published_counts(spark):
    raw = clock(spark, "2019-01-01", "2025-12-31").cache()
    assert raw.count() == 122736
    audit = quality.audit_duplicates(raw, span=1000)
    assert audit.count() == 28
    assert audit.select("settlement_datetime").distinct().count() == 14
    table = daily.daily_rollup(quality.resolve_duplicates(raw)).cache()
    assert table.count() == 2557
    bad = table.where("has_incomplete_day").select("date", "coverage_ratio").collect()
    assert len(bad) == 7
    assert (dt.date(2025, 10, 26), 0.96) in [(r.date, r.coverage_ratio) for r in bad]
    by_source = daily.daily_rollup(
        raw.withColumn("duplicate_count", F.lit(1)), count_by="source_date"
    )
    assert by_source.where("has_incomplete_day").count() == 0


def test_october_collision(spark):
    raw = clock(spark, "2025-10-26", "2025-10-27")
    assert quality.audit_duplicates(raw).count() == 4
    rows = {r.date.day: r for r in daily.daily_rollup(quality.resolve_duplicates(raw)).collect()}
    assert (rows[26].settlement_period_count, rows[26].coverage_ratio) == (48, 0.96)
    assert (rows[27].settlement_period_count, rows[27].has_incomplete_day) == (48, False)


def test_resolve_averages_and_keeps_first_non_null(spark):
    df = spark.createDataFrame(
        [("2025-10-27 00:00:00", 2, 1, 20.0, "b"), ("2025-10-27 00:00:00", 1, 49, 10.0, None)],
        "settlement_datetime string, ordinal int, settlement_period int, nd double, note string",
    ).withColumn("settlement_datetime", F.col("settlement_datetime").cast("timestamp_ntz"))
    row = quality.resolve_duplicates(df).first()
    assert (row.nd, row.settlement_period, row.note, row.duplicate_count) == (15.0, 49, "b", 2)


def test_audit_numbers_a_hot_timestamp_in_stretches(spark):
    df = spark.range(5000).select(
        F.col("id").alias("ordinal"), F.lit("2020-01-01").alias("settlement_date"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("settlement_datetime"),
    )
    got = quality.audit_duplicates(df, span=64)
    assert got.agg(F.countDistinct("duplicate_row_number"), F.max("duplicate_row_number"),
                   F.max("duplicate_group_count")).first() == (5000, 5000, 5000)


def test_gaps_and_steps(spark):
    stamps = ["00:00", "00:30", "01:00", "02:30", "03:00"]
    df = spark.createDataFrame([(f"2020-01-01 {s}:00",) for s in stamps], "settlement_datetime string").withColumn(
        "settlement_datetime", F.col("settlement_datetime").cast("timestamp_ntz")
    )
    missing = sorted(r[0].strftime("%H:%M") for r in quality.timestamp_gaps(df).collect())
    assert missing == ["01:30", "02:00"]
    row = quality.step_summary(df).first()
    assert (row.most_common_seconds, row.minimum_seconds, row.maximum_seconds, row.frequency) == (1800, 1800, 5400, None)


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    bounds = quality.iqr_bounds(df, "v").first()
    assert (bounds.q1, bounds.q3, bounds.lower, bounds.upper) == (2.0, 4.0, -1.0, 7.0)
    assert [r.v for r in quality.iqr_outliers(df, "v").collect()] == [100.0]


def test_missing_values_of_an_empty_table(spark):
    got = quality.missing_values(spark.createDataFrame([], "a int, b int")).collect()
    assert [(r.column, r.missing_count, r.missing_pct) for r in got] == [("a", 0, 0.0), ("b", 0, 0.0)]


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "constant", "narrow"])
def test_exact_quantiles_match_numpy(spark, shape):
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(0, 1, 3000), "heavy": np.exp(rng.normal(0, 8, 3000)),
        "ties": rng.integers(0, 4, 3000).astype(float), "constant": np.full(500, 7.5),
        "narrow": 1e9 + rng.random(2000),
    }[shape]
    # one key holds most rows
    rows = [("hot" if i % 7 else "cold", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"], bins=256, coarse=16).collect()}
    for key in ("hot", "cold"):
        mine = [v for k, v in rows if k == key]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(mine, p), rel=1e-12, abs=1e-12)
    whole = exact_quantiles(df, "v", probs).first()
    assert whole["c"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12)
    assert bounded_quantiles(df, "v", {"c": 0.5}).first().c == pytest.approx(whole["c"])


def test_numbering_and_halo_equal_one_plain_window(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.rand(1).alias("v")
    )
    plain = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", (F.row_number().over(plain) - 1).alias("p"),
                     F.lag("v", 28).over(plain).alias("l"), F.avg("v").over(plain.rowsBetween(-30, 5)).alias("m"))
    placed = numbered(df, ["k"], ["t"], F.floor(F.col("t") / 37), "_pos", "n")
    line = split_window(["k"])
    got = own_rows(with_halo(placed, "_pos", 50, 30, 5).withColumns({
        "l": F.lag("v", 28).over(line), "m": F.avg("v").over(line.rowsBetween(-30, 5))}))
    both = got.join(want.withColumnsRenamed({"l": "l2", "m": "m2"}), ["k", "t"])
    wrong = both.where(
        "_pos <> p or not (l <=> l2) or abs(m - m2) > 1e-12 or n <> case when k = 0 then 334 else 333 end"
    )
    assert both.count() == 1000 and wrong.count() == 0
    with pytest.raises(ValueError):
        with_halo(placed, "_pos", 10, 30)


def test_steps_carry_over_minutes_and_days(spark):
    start = dt.datetime(2024, 1, 1)
    offsets = [0, 10, 59, 60, 3600, 86399, 86400, 86401, 5 * 86400 + 30, 5 * 86400 + 31, 7 * 86400 - 1, 7 * 86400]
    rows = [(k, start + dt.timedelta(seconds=s)) for k, part in (("a", offsets), ("b", offsets[::3]), (None, offsets[1::2])) for s in [*part, part[-1]]]
    df = spark.createDataFrame(rows, "k string, settlement_datetime timestamp")
    found = [tuple(r) for r in quality.step_differences(df, keys=["k"]).select("k", "settlement_datetime", "step_micros").collect()]
    want = []
    for k in ("a", "b", None):
        stamps = sorted({t for key, t in rows if key == k})
        want += [(k, b, int((b - a).total_seconds()) * 1_000_000) for a, b in zip(stamps, stamps[1:])]
    assert sorted(found, key=str) == sorted(want, key=str)
