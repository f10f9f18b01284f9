"""Statistics that the built-in functions do not cover in every case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over rows where both sides are known; null when a side never varies.

    The built-in ``corr`` fails on a constant side under ANSI rules. The two regression slopes are null
    there, and their product is the squared correlation.
    """
    there, back = F.regr_slope(a, b), F.regr_slope(b, a)
    return F.signum(there) * F.sqrt(there * back)
