import datetime as dt

from pyspark.sql import functions as F

from meterloom.functions.clock import add_calendar, expected_periods, parse_stamp
from meterloom.functions.names import (
    daily_mean_columns, default_target, demand_columns, normalise, normalise_columns, ordered_union,
)
from meterloom.operators.quality import add_stamp, detect_datetime_columns, ensure_stamp
import pytest


def test_periods_spill_over_and_reject_zero(spark):
    df = spark.createDataFrame(
        [("26-OCT-2025", p) for p in (1, 48, 49, 50, 0)], "settlement_date string, settlement_period int"
    )
    got = {r.settlement_period: r.settlement_datetime for r in add_stamp(df).collect()}
    assert got == {
        1: dt.datetime(2025, 10, 26, 0, 0), 48: dt.datetime(2025, 10, 26, 23, 30),
        49: dt.datetime(2025, 10, 27, 0, 0), 50: dt.datetime(2025, 10, 27, 0, 30), 0: None,
    }


def test_expected_periods_on_clock_change_days(spark):
    days = spark.createDataFrame([("2025-03-30",), ("2025-10-26",), ("2025-10-27",)], "d string")
    got = days.select(expected_periods(F.col("d").cast("date")).alias("n")).collect()
    assert [r.n for r in got] == [46, 50, 48]


def test_dates_parse_in_both_formats_and_bad_ones_are_null(spark):
    df = spark.createDataFrame([("01-JAN-2019",), ("01-Jan-2019",), (" 2019-01-01 ",), ("x",), (None,)], "s string")
    got = [r.d for r in df.select(F.to_date(parse_stamp(F.col("s"))).alias("d")).collect()]
    assert got == [dt.date(2019, 1, 1)] * 3 + [None, None]


def test_unrepairable_stamp_fails(spark):
    df = spark.createDataFrame([("x", "2020-01-01", 0)], "settlement_datetime string, settlement_date string, settlement_period int")
    with pytest.raises(Exception, match="cannot be parsed"):
        ensure_stamp(df).collect()
    with pytest.raises(KeyError):
        add_stamp(spark.createDataFrame([(1,)], "a int"))


def test_calendar_keeps_existing_columns_but_derives_seasons(spark):
    df = spark.createDataFrame([("2024-12-30", 7)], "date string, month int").withColumn("date", F.col("date").cast("date"))
    row = add_calendar(df).first()
    assert (row.month, row.day_of_week, row.week_of_year, row.quarter) == (7, 0, 1, 4)
    assert row.is_winter and row.is_peak_season and not row.is_summer and not row.is_weekend


def test_names(spark):
    assert normalise("  Settlement  Date-(UTC) ") == "settlement_date_utc"
    assert normalise_columns(spark.createDataFrame([(1,)], "`A b` int")).columns == ["a_b"]
    df = spark.createDataFrame(
        [], "tsd double, national_load double, nd double, total_generation double, ifa_flow double, note string, "
        "embedded_wind_capacity double"
    )
    assert demand_columns(df) == ["nd", "tsd", "national_load"]
    assert default_target(df) == "nd"
    assert daily_mean_columns(df) == ["ifa_flow", "embedded_wind_capacity"]
    assert ordered_union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_datetime_columns_are_detected(spark):
    rows = [(f"2020-01-{d:02d}", "abc" if d < 5 else f"2020-01-{d:02d}", d) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "good string, mixed string, n int").withColumn("day", F.current_date())
    assert detect_datetime_columns(df) == ["good", "day"]
