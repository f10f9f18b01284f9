"""Augmented Dickey-Fuller test with the lag chosen by AIC, from aggregated products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.profile import latest_rolling, positioned, rolling_statistics
from meterloom.operators.regression import added_products, solve, square
from meterloom.operators.series import Keys, attach, join_series, with_halo
from meterloom.session import cut_lineage

# Published critical values of the constant-only test, as polynomials in 1/n.
CRITICAL = {
    "1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "10pct": (-2.56677, -1.5384, -2.809, 0.0),
}
FEWEST_ROWS = 20


def longest_lag(rows: int) -> int:
    """Largest lag considered for a series of this length."""
    return min(rows // 2 - 2, math.ceil(12 * (rows / 100) ** 0.25))


def _regression(m: np.ndarray, lags: int) -> tuple[float, float, np.ndarray]:
    """Residual sum of squares, level coefficient and its scaled inverse for the first ``lags`` lag terms."""
    use = np.arange(1, 3 + lags)
    inputs, cross = m[np.ix_(use, use)], m[use, 0]
    weights = solve(inputs, cross)
    rest = max(m[0, 0] - weights @ cross, 0.0)
    unit = np.zeros(len(use))
    unit[1] = 1.0
    return rest, float(weights[1]), solve(inputs, unit)


def dickey_fuller(
    df: DataFrame, stamp: str, value: str, keys: Keys = (), block: int = 4096, lag: int | None = None
) -> DataFrame:
    """Statistic, chosen lag, rows used, AIC and whether each critical value is passed, per series.

    Lags are compared on the rows that all of them can use; the test then runs once more on the rows the
    chosen lag can use. A series is cut into blocks of ``block`` rows with the few earlier rows that lags reach
    for; each block forms its own lagged products, and only those are added up, so no table of lagged columns
    is ever stored or shuffled. Series below 20 rows give no result. A level offset is removed first, which
    the constant absorbs. With ``lag`` that one is used, as far as the rows allow it, and none is chosen.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull()).select(*keys, stamp, F.col(value).cast("double").alias("_raw"))
    centre = known.groupBy(*keys).agg(F.avg("_raw").alias("_mean"), F.count(F.lit(1)).alias("_size"))
    usable = centre.where(F.col("_size") >= FEWEST_ROWS)
    # one whole number reaches the driver: the length that sizes the widest regression
    top = usable.agg(F.max("_size").alias("n")).first().n
    widest = longest_lag(top) if top else 1
    rows = positioned(join_series(known, usable, keys, how="inner") if keys else attach(known, usable, keys), stamp, keys)
    rows = rows.where(F.col("_size") >= FEWEST_ROWS).withColumn("_y", F.col("_raw") - F.col("_mean"))
    limit = F.least(
        F.floor(F.col("_size") / 2) - 2, F.ceil(12 * F.pow(F.col("_size") / 100, F.lit(0.25)))
    ).cast("int")
    if lag is not None:
        limit, widest = F.least(limit, F.lit(lag)), min(widest, lag)
    split = with_halo(rows, "_pos", max(block, widest + 2), widest + 1)
    blocks = cut_lineage(split.select(*keys, "_block", "_own", "_pos", "_y", limit.alias("_lags")))
    size = widest + 3
    upper = np.triu_indices(size)

    def lagged(group: pd.DataFrame) -> pd.DataFrame:
        """Products of move, constant, level before and earlier moves over the block's own usable rows."""
        group = group.sort_values("_pos")
        y, lags = group["_y"].to_numpy(float), int(group["_lags"].iloc[0])
        move = np.diff(y)
        at = np.flatnonzero(group["_own"].to_numpy(bool))
        at = at[at >= lags + 1]
        x = np.zeros((len(at), size))
        x[:, 0], x[:, 1], x[:, 2] = move[at - 1], 1.0, y[at - 1]
        for k in range(1, lags + 1):
            x[:, 2 + k] = move[at - 1 - k]
        first = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame({**first, "_rows": [len(at)], "_sums": [(x.T @ x)[upper]]})

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in keys], "_rows long, _sums array<double>"])
    summed = lambda part: added_products(part.groupBy(*keys, "_block").applyInPandas(lagged, schema), keys)

    @F.pandas_udf("lag int, aic double")
    def choose(n: pd.Series, most: pd.Series, sums: pd.Series) -> pd.DataFrame:
        found = []
        for count, limit_, values in zip(n, most, sums):
            m = square(np.asarray(values, float), size)
            scores = []
            for tried in range(int(limit_) + 1) if lag is None else [int(limit_)]:
                rest, _, _ = _regression(m, tried)
                fit = -count / 2 * (math.log(2 * math.pi) + math.log(max(rest, 1e-300) / count) + 1)
                scores.append((-2 * fit + 2 * (tried + 2), tried))
            best = min(scores)
            found.append((best[1], best[0]))
        return pd.DataFrame(found, columns=["lag", "aic"])

    @F.pandas_udf("double")
    def statistic(n: pd.Series, lag: pd.Series, sums: pd.Series) -> pd.Series:
        def one(count, used, values):
            rest, weight, inverse = _regression(square(np.asarray(values, float), size), int(used))
            variance = rest / (count - used - 2)
            return weight / math.sqrt(variance * inverse[1]) if variance * inverse[1] > 0 else float("nan")

        return pd.Series([one(*row) for row in zip(n, lag, sums)])

    limits = blocks.groupBy(*keys).agg(F.max("_lags").alias("_most"))
    chosen = cut_lineage(
        attach(summed(blocks), limits, keys)
        .withColumn("_c", choose("_n", "_most", "_products"))
        .select(*keys, F.col("_c.lag").alias("adf_used_lag"), F.col("_c.aic").alias("adf_icbest"))
    )
    narrowed = attach(blocks.drop("_lags"), chosen.select(*keys, F.col("adf_used_lag").alias("_lags")), keys)
    tested = attach(summed(narrowed), chosen, keys).select(
        *keys, statistic("_n", "adf_used_lag", "_products").alias("adf_statistic"),
        "adf_used_lag", F.col("_n").alias("adf_n_obs"), "adf_icbest",
    )
    inverse = 1 / F.col("adf_n_obs")
    for name, (a, b, c, d) in CRITICAL.items():
        tested = tested.withColumn(f"critical_{name}", a + inverse * (b + inverse * (c + inverse * d)))
    return tested.withColumns({
        f"rejects_at_{name}": F.col("adf_statistic") < F.col(f"critical_{name}") for name in CRITICAL
    })


def stationarity(df: DataFrame, stamp: str, value: str, keys: Keys = ()) -> DataFrame:
    """Latest rolling statistics and the test, one row per series."""
    rolling = latest_rolling(rolling_statistics(df, stamp, value, None, keys), stamp, keys)
    return attach(rolling, dickey_fuller(df, stamp, value, keys), list(keys))
