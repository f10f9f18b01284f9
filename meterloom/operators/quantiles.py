"""Exact linearly interpolated quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.series import Keys, attach, join_series
from meterloom.session import cut_lineage


def bounded_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Keys = ()
) -> DataFrame:
    """Quantiles of groups whose size is bounded, such as the days of one series."""
    return df.groupBy(*keys).agg(
        *[F.percentile(F.col(value), F.lit(p)).alias(name) for name, p in probs.items()]
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Keys = (),
    bins: int = 1 << 16,
    coarse: int = 1 << 8,
    most: int = 100_000,
) -> DataFrame:
    """Quantiles of groups of any size; no group ever meets in one task and no raw row is shuffled.

    The value range of a group is cut into ``bins`` equal bins on a logarithmic scale, and rows are
    counted per bin before any shuffle. Counts, summed up first over runs of ``coarse`` bins, tell
    which bins hold the wanted ranks; only the distinct values of those bins are ranked. A bin that holds
    more than ``most`` rows of different values is cut again, between its own smallest and largest value,
    until none does: far outliers cost another pass, not a large sort. Minimum, maximum and counts do not
    depend on the order of rows, so a recomputed task gives the same bins. Ranges and chosen bins are
    written between the passes: their size on disk, not a guess, lets the optimiser broadcast them, and rows
    stay where they were read. Missing, not-a-number and infinite values do not count.
    """
    keys, names = list(keys), list(probs)
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).where(finite("_v"))
    span = cut_lineage(values.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_total")
    ))
    spot = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = F.array(*[
        F.struct(F.lit(2 * i + side).alias("id"), rule(spot[name]).cast("long").alias("rank"))
        for i, name in enumerate(names)
        for side, rule in enumerate((F.floor, F.ceil))
    ])

    group = [*keys, "_cell"]
    rows, scale, hits = values.withColumn("_cell", F.lit(0)), _log_scale, []
    cells = span.select(*keys, F.lit(0).alias("_cell"), "_lo", "_hi", wanted.alias("_ranks"))
    while True:
        low, width = scale(F.col("_lo")), F.nullif(scale(F.col("_hi")) - scale(F.col("_lo")), F.lit(0.0))
        share = F.coalesce((scale(F.col("_v")) - low) / width, F.lit(0.0))
        bin_no = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        binned = join_series(rows, cells.drop("_ranks"), group, how="inner").select(*group, bin_no.alias("_bin"), "_v")
        sizes = binned.groupBy(*group, "_bin").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        ).withColumn("_run", F.floor(F.col("_bin") / coarse).cast("int"))
        runs = join_series(sizes.groupBy(*group, "_run").agg(F.sum("_n").alias("_n")), cells.select(*group, "_ranks"), group, how="inner")
        in_run = _holding(runs, group, "_run")
        in_bin = cut_lineage(_holding(
            join_series(sizes, in_run, [*group, "_run"], how="inner"), [*group, "_run"], "_bin", ["_n", "_lo", "_hi"]
        ))
        hits.append(in_bin.where("_lo = _hi").select(*keys, F.col("_lo").alias("_v"), F.explode("_ranks.id").alias("_id")))
        small = in_bin.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= most))
        distinct = join_series(binned, small.select(*group, "_bin"), [*group, "_bin"], how="left_semi").groupBy(
            *group, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"))
        ranked = join_series(distinct, small.select(*group, "_bin", "_ranks"), [*group, "_bin"], how="inner")
        hits.append(_holding(ranked, [*group, "_bin"], "_v").select(*keys, "_v", F.explode("_ranks.id").alias("_id")))
        large = in_bin.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > most))
        if large.isEmpty():
            break
        # At most two cells per wanted quantile and group are cut again; they get numbers of their own.
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("_cell", "_bin"))
        large = cut_lineage(large.withColumn("_next", number))
        kept = join_series(binned, large.select(*group, "_bin", "_next"), [*group, "_bin"], how="inner")
        rows = cut_lineage(kept.select(*keys, F.col("_next").alias("_cell"), "_v"))
        cells = large.select(*keys, F.col("_next").alias("_cell"), "_lo", "_hi", "_ranks")
        scale = lambda v: v
    picked = union_all(hits).groupBy(*keys).agg(*[
        F.max(F.when(F.col("_id") == j, F.col("_v"))).alias(f"_x{j}") for j in range(2 * len(names))
    ])
    return attach(picked, span.select(*keys, "_total"), keys).select(*keys, *[
        (
            F.col(f"_x{2 * i}")
            + (F.col(f"_x{2 * i + 1}") - F.col(f"_x{2 * i}")) * (spot[name] - F.floor(spot[name]))
        ).alias(name)
        for i, name in enumerate(names)
    ])


def _log_scale(v: Column) -> Column:
    """Monotone scale on which heavy tails spread out."""
    return F.signum(v) * F.log1p(F.abs(v))


def finite(name: str) -> Column:
    """Whether a double is a number that can be ranked or binned."""
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < F.lit(float("inf")))


def _holding(parts: DataFrame, group: list[str], order: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parts (of ``_n`` rows each, along ``order``) that hold a rank of ``_ranks``, counted from their start."""
    along = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_end")
    start = end - F.col("_n")
    inside = F.transform(
        F.filter("_ranks", lambda r: (r["rank"] >= start) & (r["rank"] < end)),
        lambda r: F.struct(r["id"].alias("id"), (r["rank"] - start).alias("rank")),
    )
    names = list(dict.fromkeys([*group, order, *keep]))
    return (
        parts.withColumn("_end", F.sum("_n").over(along))
        .select(*names, inside.alias("_ranks"))
        .where(F.size("_ranks") > 0)
    )


def interpolated(sorted_values: str, p: float) -> Column:
    """Quantile of an already sorted array column, by the same linear interpolation."""
    array = F.col(sorted_values)
    spot = (F.size(array) - 1) * F.lit(float(p))
    low = F.get(array, F.floor(spot).cast("int"))
    high = F.get(array, F.ceil(spot).cast("int"))
    return low + (high - low) * (spot - F.floor(spot))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
