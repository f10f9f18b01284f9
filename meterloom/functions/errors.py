"""Forecast error expressions shared by every evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_columns(actual: Column, forecast: Column) -> dict[str, Column]:
    """Signed, absolute and percentage error; a zero actual has no percentage error."""
    error = actual - forecast
    return {
        "error": error,
        "absolute_error": F.abs(error),
        "absolute_percentage_error": F.abs(error) / F.nullif(actual, F.lit(0.0)) * 100,
    }


def metric_aggregates(actual: Column, forecast: Column) -> list[Column]:
    """MAE, RMSE and MAPE. Rows with a null on either side drop out of all three."""
    error = actual - forecast
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error) / F.nullif(actual, F.lit(0.0))) * 100).alias("mape"),
    ]
