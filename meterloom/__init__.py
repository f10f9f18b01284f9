"""Spark-native analysis and forecasting of panels of regularly sampled measurements."""

__version__ = "0.1.0"
