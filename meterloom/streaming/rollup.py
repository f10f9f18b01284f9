"""Duplicate resolution and daily coverage over a stream of settlement records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.clock import expected_periods
from meterloom.operators.quality import STAMP
from meterloom.operators.series import Keys


def resolved_stream(
    records: DataFrame, measures: list[str], keys: Keys = (), stamp: str = STAMP, late: str = "2 days",
    period: str = "30 minutes",
) -> DataFrame:
    """One row per period with averaged measurements and the number of records behind it.

    A period is final once the watermark has passed it; state holds the open periods only.
    """
    timed = records.withColumn("_t", F.col(stamp).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(*keys, F.window("_t", period).alias("_p")).agg(
        *[F.avg(c).alias(c) for c in measures], F.count(F.lit(1)).alias("duplicate_count")
    )


def daily_stream(
    records: DataFrame, measures: list[str], keys: Keys = (), stamp: str = STAMP, late: str = "2 days",
    period: str = "30 minutes",
) -> DataFrame:
    """Daily means, peaks and coverage of the resolved periods, emitted when a day can no longer change."""
    halves = resolved_stream(records, measures, keys, stamp, late, period)
    days = halves.groupBy(*keys, F.window(F.window_time("_p"), "1 day").alias("_d")).agg(
        F.count(F.lit(1)).alias("settlement_period_count"),
        *[a for c in measures for a in (F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_peak"))],
    )
    date = F.to_date("_d.start")
    ratio = F.col("settlement_period_count") / expected_periods(F.col("date"))
    return (
        days.withColumn("date", date).drop("_d")
        .withColumns({"coverage_ratio": ratio, "has_incomplete_day": ratio < 1})
    )
