"""Naive forecasts that look up earlier days of the training period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.series import Keys, attach, join_series


def last_value(train: DataFrame, target: str, keys: Keys = ()) -> DataFrame:
    """Last known training value of each series."""
    return train.groupBy(*keys).agg(
        F.max_by(target, F.when(F.col(target).isNotNull(), F.col("date"))).alias("_last")
    )


def _looked_up(test: DataFrame, train: DataFrame, target: str, keys: Keys, when: Column, name: str) -> DataFrame:
    """Training value of the day ``when`` refers to."""
    past = train.where(F.col(target).isNotNull()).select(
        *keys, F.col("date").alias("_day"), F.col(target).alias(name)
    )
    return join_series(test.withColumn("_day", when), past, keys, ["_day"]).drop("_day")


def _forecasts(
    train: DataFrame, test: DataFrame, target: str, keys: Keys, tiers: dict[str, Column], out: str
) -> DataFrame:
    found = test.select(*keys, "date", F.col(target).alias("actual"))
    for name, when in tiers.items():
        found = _looked_up(found, train, target, keys, when, name)
    known = attach(found, last_value(train, target, keys), keys)
    value = F.coalesce(*[F.col(n) for n in tiers], F.col("_last"))
    return known.select(*keys, "date", "actual", value.alias(out))


def naive(train: DataFrame, test: DataFrame, target: str, keys: Keys = ()) -> DataFrame:
    """Last known training value for every test day."""
    return _forecasts(train, test, target, keys, {}, "naive_forecast")


def seasonal_naive(
    train: DataFrame, test: DataFrame, target: str, keys: Keys = (), use_365: bool = True
) -> DataFrame:
    """Same calendar day a year earlier, else 365 days earlier, else the last training value."""
    tiers = {"_year": F.add_months("date", -12)}
    if use_365:
        tiers["_d365"] = F.date_sub("date", 365)
    return _forecasts(train, test, target, keys, tiers, "seasonal_naive_forecast")


def weekly_naive(train: DataFrame, test: DataFrame, target: str, keys: Keys = ()) -> DataFrame:
    """Same weekday a week earlier while that day is still training, else the last training value."""
    return _forecasts(
        train, test, target, keys, {"_week": F.date_sub("date", 7)}, "weekly_seasonal_naive_forecast"
    )
