"""Shared building blocks: attaching statistics, numbering long series, windows over split series.

A daily table holds one row per series and calendar day, so one series is bounded by the length of
the calendar (36,525 rows per century) however many raw rows fed it; plain windows by series are safe
there. Sub-daily and raw tables have no such bound: they are numbered and windowed in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def by_series(keys: Keys, order: str | Sequence[str] = "date") -> WindowSpec:
    """Rows of one series in time order. Meant for daily tables, see the module note."""
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order)


def join_series(left: DataFrame, right: DataFrame, keys: Keys, others: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Equi-join in which a null key is a series like any other; ``others`` are plain join columns.

    Null-safe equality is still a hash or sort key for the optimiser. Columns come in the order of ``left``.
    """
    on = [*keys, *others]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    equal = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) if c in keys else F.col(c) == F.col(f"_right_{c}") for c in on]
    joined = left.join(renamed, reduce(Column.__and__, equal), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{c}" for c in on])


def attach(df: DataFrame, stats: DataFrame, keys: Keys) -> DataFrame:
    """Add one-row-per-series statistics to every row of the series.

    Without keys the statistics are a single row, read as a scalar subquery. With keys it is an
    equi-join without a hint: the optimiser broadcasts only a side whose size it has checked.
    """
    values = [c for c in stats.columns if c not in keys]
    if keys:
        return join_series(df, stats, keys)
    packed = stats.select(F.struct(*values)).scalar()
    return (
        df.withColumn("_stats", packed)
        .select(*df.columns, *[F.col("_stats")[c].alias(c) for c in values])
    )


def numbered(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    bucket: Column,
    position: str = "_pos",
    total: str | None = None,
) -> DataFrame:
    """Dense 0-based position of every row within its group, without sorting a group in one task.

    ``bucket`` must not decrease along ``order``. Buckets are counted, their counts are summed up to
    offsets, and rows are numbered inside their bucket only, so the largest sort is one bucket.
    """
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    out = join_series(bucketed.withColumn("_local", local), offsets, [*keys, "_bucket"], how="inner").withColumn(
        position, F.col("_before") + F.col("_local")
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_before", "_local", "_total")


def with_halo(
    df: DataFrame, position: str, block: int, back: int, ahead: int = 0
) -> DataFrame:
    """Cut a numbered series into blocks and lend each block the rows its windows reach for.

    Adds ``_block`` (window partition) and ``_own`` (false for lent copies). Each row is copied at
    most twice; windows reaching ``back`` rows or fewer backwards and ``ahead`` forwards are exact.
    """
    if max(back, ahead) > block:
        raise ValueError("a window may not reach further than one block")
    number = F.floor(F.col(position) / block).cast("long")
    inside = F.col(position) % block
    copies = [F.struct(number.alias("b"), F.lit(True).alias("own"))]
    if back:
        copies.append(
            F.when(inside >= block - back, F.struct((number + 1).alias("b"), F.lit(False).alias("own")))
        )
    if ahead:
        copies.append(
            F.when((inside < ahead) & (number > 0), F.struct((number - 1).alias("b"), F.lit(False).alias("own")))
        )
    return (
        df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumns({"_block": F.col("_copy.b"), "_own": F.col("_copy.own")})
        .drop("_copy")
    )


def split_window(keys: Keys, position: str = "_pos") -> WindowSpec:
    """Window over one block of one series, as prepared by :func:`with_halo`."""
    return Window.partitionBy(*keys, "_block").orderBy(position)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the lent copies."""
    return df.where("_own").drop("_own", "_block")


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Deal rows evenly over all tasks before work that is heavy per row.

    Adaptive execution sizes tasks by bytes and would leave few of them; a series that holds most rows
    would stay in one task after a join by series.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by)
