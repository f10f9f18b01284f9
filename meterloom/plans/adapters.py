"""Inputs of the registered queries, derived from the whole order, line item and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators.daily import exact_mean

TEST_START, TEST_END = "2000-01-01", "2000-12-31"
TARGET = "value_mean"
SERIES = ["series"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily_orders(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Daily mean and peak of the order value, one series per priority unless ``keys`` is empty."""
    keys = SERIES if keys is None else keys
    orders = table(spark, folder, "orders").withColumn("series", F.col("o_orderpriority"))
    return orders.groupBy(*keys, F.to_date("o_orderdate").alias("date")).agg(
        exact_mean(F.col("o_totalprice"), 2).alias("value_mean"), F.max("o_totalprice").alias("value_peak")
    )


def daily_exogenous(spark: SparkSession, folder: str) -> DataFrame:
    """Daily line item means in the roles of wind, solar, capacity and flow."""
    items = table(spark, folder, "lineitem")
    return items.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        exact_mean(F.col("l_quantity"), 2).alias("embedded_wind_generation_mean"),
        (exact_mean(F.col("l_discount"), 2) * 100).alias("embedded_solar_generation_mean"),
        (exact_mean(F.col("l_tax"), 2) * 100).alias("embedded_solar_capacity_mean"),
        exact_mean(F.col("l_extendedprice"), 2).alias("ifa_flow_mean"),
    )


EXOGENOUS = [
    "embedded_wind_generation_mean", "embedded_solar_generation_mean", "embedded_solar_capacity_mean", "ifa_flow_mean",
]


def daily_joined(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Order series next to the exogenous means of the same day."""
    return daily_orders(spark, folder, keys).join(daily_exogenous(spark, folder), "date", "left")


def half_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw settlement records; several events per half-hour play the duplicates."""
    events = table(spark, folder, "events")
    clock = F.hour("ts") * 2 + F.when(F.minute("ts") >= 30, 1).otherwise(0) + 1
    kind = lambda name: F.when(F.col("event_type") == name, F.col("value"))
    return events.select(
        F.col("event_id").alias("ordinal"),
        F.to_date("ts").alias("settlement_date"),
        clock.alias("settlement_period"),
        F.year("ts").alias("source_year"),
        F.col("value").alias("nd"),
        kind("view").alias("tsd"),
        kind("click").alias("embedded_wind_generation"),
        kind("purchase").alias("pump_storage_pumping"),
        "event_type",
    )
