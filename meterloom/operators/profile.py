"""Profiles of a measurement: summaries, patterns, histograms, correlations, rolling statistics, decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.stats import pearson
from meterloom.operators.quantiles import exact_quantiles, finite, union_all
from meterloom.operators.series import (
    Keys, attach, join_series, numbered, own_rows, split_window, with_halo,
)
from meterloom.session import cut_lineage


def target_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing, mean, spread, extremes and median of each candidate target.

    One wide aggregate serves all columns; each median reads its own column only.
    """
    def measures(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing_count"),
            (F.avg(v.isNull().cast("int")) * 100).alias("missing_pct"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        )

    basics = df.agg(F.array(*map(measures, columns)).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    medians = union_all([
        exact_quantiles(df, c, {"median": 0.5}).select(F.lit(c).alias("column"), "median") for c in columns
    ])
    return attach(basics, medians, ["column"])


def describe(df: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """Count, mean, spread, quartiles and extremes, overall or by group."""
    c = F.col(value)
    basics = df.groupBy(*keys).agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"),
    )
    return attach(basics, exact_quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys), keys)


def pattern_means(df: DataFrame, stamp: str, value: str, keys: Keys = ()) -> DataFrame:
    """Mean by hour, weekday, month and year.

    Rows are first reduced to one partial sum per year, month, weekday and hour; the four groupings
    then run over that small table instead of over four copies of every row.
    """
    t = F.col(stamp)
    parts = {"year": F.year(t), "month": F.month(t), "day_of_week": F.weekday(t), "hour": F.hour(t)}
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, *[c.alias(n) for n, c in parts.items()]).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    long = cells.select(*keys, "_s", "_n", F.explode(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.col(n).cast("int").alias("slot")) for n in parts
    ])).alias("e"))
    return long.groupBy(*keys, "e.pattern", "e.slot").agg(
        (F.sum("_s") / F.sum("_n")).alias("mean_value"), F.sum("_n").alias("rows")
    )


def histogram(df: DataFrame, value: str, bins: int = 50, keys: Keys = ()) -> DataFrame:
    """Equal-width histogram between the smallest and the largest value, which falls in the last bin.

    Missing, not-a-number and infinite values do not count.
    """
    known = df.select(*keys, F.col(value).cast("double").alias("v")).where(finite("v"))
    span = known.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    if keys:
        span = cut_lineage(span)  # its written size decides how it joins the rows
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    number = F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = attach(known, span, keys).groupBy(*keys, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    return counts.select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "rows",
        (F.col("rows") / F.sum("rows").over(Window.partitionBy(*keys)) / F.nullif(width, F.lit(0.0))).alias("density"),
    )


def density_curve(
    df: DataFrame, value: str, points: int = 200, bandwidth: float | None = None, bins: int = 4096
) -> DataFrame:
    """Gaussian kernel density on a grid, from value counts binned finely below the bandwidth.

    Without a bandwidth the normal-reference rule ``sd * n^(-1/5)`` applies. Each grid point reads the bin
    counts, not the rows, so the work after one counting pass does not grow with the table.
    """
    known = df.select(F.col(value).cast("double").alias(value)).where(finite(value))
    fine = histogram(known, value, bins)
    stats = known.select(
        F.stddev_samp(value).alias("sd"), F.count(value).alias("n"),
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
    )
    h = F.lit(float(bandwidth)) if bandwidth else F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    h = F.nullif(h, F.lit(0.0))
    packed = fine.agg(F.collect_list(F.struct(F.col("bin"), F.col("rows"))).alias("cells"))
    grid = attach(stats.withColumn("h", h), packed, []).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    centre = lambda c: F.col("lo") + (F.col("hi") - F.col("lo")) * (c["bin"] + 0.5) / bins
    kernel = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["rows"] * F.exp(
        -F.pow((x - centre(c)) / F.col("h"), F.lit(2.0)) / 2
    ))
    return grid.select(x.alias("x"), (kernel / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))).alias("density"))


def correlations(df: DataFrame, target: str, columns: list[str], keys: Keys = ()) -> DataFrame:
    """Pearson correlation of each column with the target over rows where both are known."""
    wide = df.groupBy(*keys).agg(*[pearson(c, target).alias(c) for c in columns])
    return wide.unpivot(list(keys), columns, "column", "correlation_with_target")


def strongest(table: DataFrame, n: int, leave_out: list[str] = ()) -> list[str]:
    """The ``n`` columns of a correlation table with the largest absolute value, ties by name; a handful of names."""
    known = table.where(F.col("correlation_with_target").isNotNull() & ~F.col("column").isin(list(leave_out) or [""]))
    order = [F.abs("correlation_with_target").desc(), "column"]
    return [r.column for r in known.orderBy(*order).limit(n).collect()]


def correlation_matrix(df: DataFrame, columns: list[str], keys: Keys = ()) -> DataFrame:
    """All pairwise correlations from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*keys).agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot(list(keys), [f"{a}|{b}" for a, b in pairs], "pair", "correlation").select(
        *keys,
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("column_a"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("column_b"),
        "correlation",
    )


def feature_correlations(
    df: DataFrame, features: list[str], targets: list[str], keys: Keys = ()
) -> DataFrame:
    """Correlation of every feature with every target, one row per feature."""
    wide = df.groupBy(*keys).agg(*[
        pearson(F.col(f).cast("double"), F.col(t)).alias(f"{f}|{t}") for f in features for t in targets
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[
            F.col(f"{f}|{t}").alias(f"correlation_with_{t}") for t in targets])
        for f in features
    ])).alias("e")
    return wide.select(*keys, rows).select(*keys, "e.*")


def positioned(df: DataFrame, stamp: str, keys: Keys = (), total: str | None = None) -> DataFrame:
    """Number the rows of a sub-daily series, an hour at a time."""
    return numbered(df, keys, [stamp], F.date_trunc("hour", F.col(stamp)), "_pos", total)


def lagged_correlations(
    df: DataFrame, stamp: str, target: str, columns: list[str],
    lags: tuple[int, ...] = (1, 2, 24, 48), keys: Keys = (), block: int = 4096,
) -> DataFrame:
    """Correlation of the target with earlier rows of each column, over a series split into blocks."""
    window = split_window(keys)
    split = with_halo(positioned(df, stamp, keys), "_pos", block, max(lags))
    shifted = own_rows(split.withColumns({
        f"_{c}_{k}": F.lag(c, k).over(window) for c in columns for k in lags
    }))
    wide = shifted.groupBy(*keys).agg(*[
        pearson(F.col(target), F.col(f"_{c}_{k}")).alias(f"_{c}_{k}") for c in columns for k in lags
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("lag"), F.col(f"_{c}_{k}").alias("lagged_correlation"))
        for c in columns for k in lags
    ])).alias("e")
    return wide.select(*keys, rows).select(*keys, "e.*")


def stationarity_window(rows: Column) -> Column:
    """Rolling window length: a twentieth of the series, between 2 and 48 rows."""
    return F.least(F.lit(48), F.greatest(F.lit(2), F.floor(rows / 20))).cast("int")


def rolling_statistics(
    df: DataFrame, stamp: str, value: str, window: int | None = None, keys: Keys = (), block: int = 4096
) -> DataFrame:
    """Rolling mean and sample deviation over full windows.

    Without a length the rule of :func:`stationarity_window` picks one per series. The lengths that occur,
    48 different ones at most, each get an ordinary row frame.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, stamp, F.col(value).cast("double").alias(value))
    if window:
        lengths = [window]
    else:
        sizes = known.groupBy(*keys).agg(stationarity_window(F.count(F.lit(1))).alias("w"))
        lengths = sorted(r.w for r in sizes.select("w").distinct().collect()) or [2]
    split = with_halo(positioned(known, stamp, keys, "_rows"), "_pos", block, max(lengths))
    split = split.withColumn("rolling_window", F.lit(window) if window else stationarity_window(F.col("_rows")))
    full = F.col("_pos") >= F.col("rolling_window") - 1

    def chosen(statistic) -> Column:
        frames = {w: statistic(value).over(split_window(keys).rowsBetween(1 - w, 0)) for w in lengths}
        return F.when(full, F.coalesce(*[F.when(F.col("rolling_window") == w, v) for w, v in frames.items()]))

    rolled = split.withColumns({"rolling_mean": chosen(F.avg), "rolling_std": chosen(F.stddev_samp)})
    return own_rows(rolled).select(*keys, stamp, "rolling_window", "rolling_mean", "rolling_std")


def latest_rolling(curve: DataFrame, stamp: str, keys: Keys = ()) -> DataFrame:
    """Last full window of each series."""
    return curve.groupBy(*keys).agg(
        F.max_by(F.struct("rolling_window", "rolling_mean", "rolling_std"),
                 F.when(F.col("rolling_mean").isNotNull(), F.col(stamp))).alias("r")
    ).select(
        *keys, "r.rolling_window",
        F.col("r.rolling_mean").alias("rolling_mean_latest"),
        F.col("r.rolling_std").alias("rolling_std_latest"),
    )


def decomposition_period(rows: int) -> int | None:
    """Half-hours of a day when two days are there, else days of a week, else none."""
    return 48 if rows >= 96 else 7 if rows >= 14 else None


def decompose(
    df: DataFrame, stamp: str, value: str, period: int, keys: Keys = (), block: int = 4096
) -> DataFrame:
    """Additive trend, seasonal and residual parts; series shorter than two periods give no rows.

    The trend is a centred moving average (half weights at both ends of an even period). Its missing
    ends follow straight lines fitted to the first and last ``period`` trend points.
    """
    half = period // 2
    known = df.where(F.col(value).isNotNull()).select(*keys, stamp, F.col(value).cast("double").alias(value))
    numbered_rows = positioned(known, stamp, keys, "_rows").where(F.col("_rows") >= 2 * period)
    split = with_halo(numbered_rows, "_pos", block, half, half)
    line = split_window(keys)
    frame = line.rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(line) + F.lead(value, half).over(line)) / 2
    inside = (F.col("_pos") >= half) & (F.col("_pos") < F.col("_rows") - half)
    smoothed = cut_lineage(own_rows(split.withColumn("_trend", total / period)).withColumn(
        "_trend", F.when(inside, F.col("_trend"))
    ))
    pos, trend = F.col("_pos"), F.col("_trend")
    head = pos < half + period
    tail = pos >= F.col("_rows") - half - period
    fits = smoothed.groupBy(*keys).agg(*[
        fit(F.when(side, trend), F.when(side, pos.cast("double"))).alias(name)
        for name, fit, side in (
            ("_hs", F.regr_slope, head), ("_hi", F.regr_intercept, head),
            ("_ts", F.regr_slope, tail), ("_ti", F.regr_intercept, tail),
        )
    ])
    completed = attach(smoothed, fits, keys).withColumn("trend", F.coalesce(
        trend,
        F.when(pos < half, F.col("_hi") + F.col("_hs") * pos).otherwise(F.col("_ti") + F.col("_ts") * pos),
    )).withColumn("_phase", F.pmod(pos, F.lit(period)).cast("int"))
    phases = completed.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_mean"))
    seasonal = phases.select(
        *keys, "_phase", (F.col("_mean") - F.avg("_mean").over(Window.partitionBy(*keys))).alias("seasonal")
    )
    return join_series(completed, seasonal, keys, ["_phase"], "inner").select(
        *keys, stamp, F.col(value).alias("observed"), "trend", "seasonal",
        (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def box_statistics(df: DataFrame, value: str, keys: Keys) -> DataFrame:
    """Quartiles and whiskers (furthest values within 1.5 quartile ranges) of bounded groups."""
    quartiles = df.groupBy(*keys).agg(*[
        F.percentile(F.col(value), F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    ])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    c = F.col(value)
    within = c.between(F.col("q1") - reach, F.col("q3") + reach)
    return attach(df, quartiles, keys).groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(within, c)).alias("whisker_low"), F.max(F.when(within, c)).alias("whisker_high"),
        F.count(c).alias("rows"),
    )


def recent_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Last ``n`` rows in time, by a per-task top-n."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def extremes(df: DataFrame, value: str, tie: str, n: int = 20) -> DataFrame:
    """The ``n`` lowest and ``n`` highest rows."""
    low = df.orderBy(F.col(value), F.col(tie)).limit(n).withColumn("side", F.lit("lowest"))
    high = df.orderBy(F.col(value).desc(), F.col(tie)).limit(n).withColumn("side", F.lit("highest"))
    return union_all([low, high])


