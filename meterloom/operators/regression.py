"""Least squares per series from sums of products, which Spark adds up over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.evaluate import ranked
from meterloom.operators.series import Keys, attach
from meterloom.session import cut_lineage


# Own choice: series whose sums one task holds before it passes them on.
HELD_SERIES = 2000


def products(df: DataFrame, columns: list[str], keys: Keys = ()) -> DataFrame:
    """Sums of all pairwise products of the columns over complete rows, as one array per series.

    Each task multiplies its own rows as matrices and passes on one row per series; those are added up
    by ordinary aggregation. No rows of a series travel, whatever its size.
    """
    keys, size = list(keys), len(columns)
    upper = np.triu_indices(size)

    def emit(sums: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(sums), columns=keys) if keys else pd.DataFrame(index=range(len(sums)))
        return out.assign(_rows=[n for n, _ in sums.values()], _sums=[m[upper] for _, m in sums.values()])

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            x = batch[columns].to_numpy(float)
            complete = np.isfinite(x).all(axis=1)
            x, batch = x[complete], batch[complete].reset_index(drop=True)
            parts = batch.groupby(keys, sort=False, dropna=False).indices if keys else {(): slice(None)}
            for key, rows in parts.items():
                key = key if isinstance(key, tuple) else (key,)
                n, m = sums.get(key, (0, 0.0))
                mine = x[rows]
                sums[key] = (n + len(mine), m + mine.T @ mine)
            if len(sums) >= HELD_SERIES:
                yield emit(sums)
                sums = {}
        if sums:
            yield emit(sums)

    numbers = df.select(
        *keys, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in numbers.schema if f.name in keys],
                        "_rows long, _sums array<double>"])
    return added_products(numbers.mapInPandas(partial, schema), keys)


def added_products(parts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Add up partial sums ``_sums`` over ``_rows`` rows each, cell by cell, to one array per series."""
    cells = parts.select(*keys, "_rows", F.posexplode("_sums").alias("_at", "_v"))
    added = cells.groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"), F.sum("_rows").alias("_n"))
    whole = added.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_cells")
    )
    return whole.where(F.col("_n") > 0).select(
        *keys, "_n", F.transform("_cells", lambda c: c["_v"]).alias("_products")
    )


def square(values: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrix from the upper triangle row by row."""
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = values
    return m + np.triu(m, 1).T


def solve(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of a small symmetric system; the least-squares one when columns depend on each other."""
    return np.linalg.lstsq(m, rhs, rcond=1e-12)[0]


def least_squares(df: DataFrame, label: str, columns: list[str], keys: Keys = ()) -> DataFrame:
    """Coefficients of ``label`` on the columns, without intercept; null for a series with fewer complete rows
    than coefficients."""
    size = len(columns) + 1

    @F.pandas_udf("array<double>")
    def coefficients(n: pd.Series, sums: pd.Series) -> pd.Series:
        def one(rows, values):
            if rows is None or rows < size - 1:
                return None
            m = square(np.asarray(values, float), size)
            return solve(m[1:, 1:], m[1:, 0])

        return pd.Series([one(a, b) for a, b in zip(n, sums)])

    return products(df, [label, *columns], keys).select(
        *keys, coefficients("_n", "_products").alias("coefficients")
    )


RIDGE_FIELDS = "intercept double, coefficients array<double>, scaled_coefficients array<double>"


def ridge(train: DataFrame, target: str, columns: list[str], keys: Keys = (), alpha: float = 1.0) -> DataFrame:
    """Ridge regression on inputs scaled by their population deviation, one model per series.

    ``coefficients`` are in original units; ``scaled_coefficients`` belong to the scaled inputs. Columns are
    centred by their series' means before they are multiplied, so an offset costs no digits; an input that does
    not vary in training has coefficient zero.
    """
    size, numbers = len(columns) + 2, [*columns, target]

    @F.pandas_udf(RIDGE_FIELDS)
    def fit(sums: pd.Series, centres: pd.Series) -> pd.DataFrame:
        rows = []
        for values, centre in zip(sums, centres):
            m = square(np.asarray(values, float), size)
            count, totals = m[0, 0], m[0, 1:]
            mean = np.asarray(centre, float) + totals / count
            centred = m[1:, 1:] - np.outer(totals, totals) / count
            deviation = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0) / count)
            varies = deviation > 1e-8 * np.abs(mean[:-1])
            scale = np.where(varies, deviation, 1.0)
            inputs = centred[:-1, :-1] / np.outer(scale, scale) * np.outer(varies, varies)
            scaled = solve(inputs + alpha * np.eye(size - 2), centred[:-1, -1] / scale * varies)
            plain = scaled / scale
            rows.append((mean[-1] - plain @ mean[:-1], plain, scaled))
        return pd.DataFrame(rows, columns=["intercept", "coefficients", "scaled_coefficients"])

    # Incomplete rows take no part in the products; the centre need only be near the mean.
    means = cut_lineage(train.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in numbers]))
    centred = attach(train.select(*keys, *numbers), means, keys).select(
        *keys, F.lit(1.0).alias("_one"), *[(F.col(c).cast("double") - F.col(f"_m_{c}")).alias(f"_c_{c}") for c in numbers]
    )
    sums = products(centred, ["_one", *[f"_c_{c}" for c in numbers]], keys)
    centres = means.select(*keys, F.array(*[f"_m_{c}" for c in numbers]).alias("_centre"))
    return attach(sums, centres, keys).withColumn("_fit", fit("_products", "_centre")).select(*keys, "_fit.*")


def ridge_residuals(model: DataFrame, train: DataFrame, target: str, columns: list[str], keys: Keys = (), alpha: float = 1.0) -> DataFrame:
    """How far a ridge model is from its normal equations, per series and input.

    In scaled inputs z the model satisfies ``sum(z * residual) = alpha * coefficient`` for every input; the difference
    is given relative to the size of the terms. It needs one pass over the rows and no other fit.
    """
    stats = train.groupBy(*keys).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns])
    rows = attach(attach(train, model, keys), stats, keys)
    rest = F.col(target).cast("double") - linear_value(columns, intercept="intercept")
    scaled = lambda c: (F.col(c).cast("double") - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
    sums = rows.groupBy(*keys).agg(
        F.first("scaled_coefficients").alias("_w"),
        *[F.sum(scaled(c) * rest).alias(f"_r_{c}") for c in columns], *[F.sum(F.abs(scaled(c) * rest)).alias(f"_a_{c}") for c in columns])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.abs(F.col(f"_r_{c}") - alpha * F.col("_w")[i]) / (F.col(f"_a_{c}") + 1.0)).alias("distance"))
        for i, c in enumerate(columns)])).alias("e")
    return sums.select(*keys, cells).select(*keys, "e.feature", F.coalesce("e.distance", F.lit(0.0)).alias("distance"))


def linear_value(columns: list[str], coefficients: str = "coefficients", intercept: str | None = None) -> Column:
    """Sum of columns times their coefficients, as one flat expression."""
    start = F.col(intercept) if intercept else F.lit(0.0)
    return sum((F.col(coefficients)[i] * F.col(c).cast("double") for i, c in enumerate(columns)), start)


def predict_linear(df: DataFrame, model: DataFrame, columns: list[str], keys: Keys, out: str) -> DataFrame:
    used = model.select(*keys, "intercept", "coefficients")
    return attach(df, used, keys).withColumn(out, linear_value(columns, intercept="intercept")).drop(
        "intercept", "coefficients"
    )


def coefficient_table(model: DataFrame, columns: list[str], keys: Keys = ()) -> DataFrame:
    """Signed coefficients of the scaled inputs with their place by absolute value, one row per input."""
    names = F.array(*map(F.lit, columns))
    table = model.select(
        *keys, F.explode(F.arrays_zip(names.alias("feature"), F.col("scaled_coefficients").alias("coefficient"))).alias("e")
    ).select(*keys, "e.feature", "e.coefficient")
    return ranked(table, "coefficient", keys, ascending=False, tie="feature", absolute=True)
