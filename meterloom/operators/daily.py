"""Daily tables: roll-up with coverage, exact means, calendar densification, fills, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.clock import add_calendar, expected_periods
from meterloom.functions.names import PREFERRED_TARGETS, daily_mean_columns
from meterloom.operators.quality import STAMP
from meterloom.operators.series import Keys, attach, by_series, join_series
from meterloom.sources.tables import require_columns

# Leading columns of a daily table in their order.
LEADING = [
    "date", "year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend",
    "settlement_period_count", "expected_settlement_period_count", "coverage_ratio",
    "has_incomplete_day",
]


def exact_mean(value: Column, decimals: int) -> Column:
    """Mean of a measurement with a fixed number of decimals, summed as whole units.

    Whole-number sums do not depend on the order of rows, so thresholds and values computed in
    different tasks, or again after an executor is lost, agree to the last bit. A value with more
    decimals ends the job instead of losing them.
    """
    scale = float(10**decimals)
    units = F.round(value * scale)
    whole = F.when(F.abs(value * scale - units) <= 1e-6 * F.greatest(F.abs(units), F.lit(1.0)), units)
    lost = F.raise_error(F.lit(f"a value has more than {decimals} decimals")).cast("double")
    checked = F.when(value.isNotNull(), F.coalesce(whole, lost)).cast("decimal(38,0)")
    return F.sum(checked).cast("double") / F.lit(scale) / F.count(value)


def daily_rollup(
    df: DataFrame,
    target: str = "nd",
    stamp: str = STAMP,
    keys: Keys = (),
    decimals: int | None = None,
    count_by: str = "stamp",
    source_date: str = "settlement_date",
) -> DataFrame:
    """Daily mean and peak of each target, mean of each external column, and period coverage.

    Days follow the timestamp, so periods that spilled over midnight count for the next day;
    ``count_by="source_date"`` groups by the recorded date instead.
    """
    require_columns(df, target, stamp)
    targets = [c for c in dict.fromkeys([*PREFERRED_TARGETS, target]) if c in df.columns]
    externals = [c for c in daily_mean_columns(df) if c not in targets]
    mean = F.avg if decimals is None else lambda c: exact_mean(c, decimals)
    day = F.to_date(stamp) if count_by == "stamp" else F.to_date(source_date)
    rolled = (
        df.where(F.col(stamp).isNotNull())
        .groupBy(*keys, day.alias("date"))
        .agg(
            F.count_distinct(stamp).alias("settlement_period_count"),
            *[a for c in targets for a in (
                mean(F.col(c)).alias(f"{c}_mean"), F.max(c).alias(f"{c}_peak"))],
            *[mean(F.col(c)).alias(f"{c}_mean") for c in externals],
        )
    )
    expected = expected_periods(F.col("date"))
    ratio = F.col("settlement_period_count") / expected
    covered = add_calendar(rolled, only=LEADING[1:8]).withColumns({
        "expected_settlement_period_count": expected,
        "coverage_ratio": ratio,
        "has_incomplete_day": ratio < 1,
    })
    rest = [c for c in rolled.columns if c not in (*keys, *LEADING)]
    return covered.select(*keys, *LEADING, *rest)


def densify(df: DataFrame, keys: Keys = (), date: str = "date") -> DataFrame:
    """Every calendar day between the first and last of a series; days without a row become nulls."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    calendar = ends.select(
        *keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date)
    )
    return join_series(calendar, df, keys, [date])


def fill_gaps(df: DataFrame, columns: list[str], keys: Keys = (), order: str = "date", bucket: Column | None = None) -> DataFrame:
    """Fill forward, then backward, then with zero.

    The next known value is the last one along the reversed order, so both directions are running frames
    that cost one step per row. With ``bucket``, which must not decrease along ``order``, a series of any length is
    filled bucket by bucket: the last and the first known value of each bucket are carried over the table of buckets,
    and rows meet only the others of their bucket.
    """
    known = lambda c, line: F.last(c, ignorenulls=True).over(line)
    running = (Window.unboundedPreceding, 0)
    if bucket is None:
        forward = by_series(keys, order).rowsBetween(*running)
        backward = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(*running)
        return df.withColumns({
            c: F.coalesce(known(c, forward), known(c, backward), F.lit(0.0)) for c in columns
        })
    cut = df.withColumn("_bucket", bucket)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = cut.groupBy(*keys, "_bucket").agg(
        *[F.min_by(c, at(c)).alias(f"_f_{c}") for c in columns], *[F.max_by(c, at(c)).alias(f"_l_{c}") for c in columns])
    before = by_series(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_bucket", *[known(f"_l_{c}", before).alias(f"_b_{c}") for c in columns],
        *[known(f"_f_{c}", behind).alias(f"_n_{c}") for c in columns])
    forward = by_series([*keys, "_bucket"], order).rowsBetween(*running)
    backward = Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).desc()).rowsBetween(*running)
    inside = cut.withColumns({f"_p_{c}": known(c, forward) for c in columns}).withColumns({f"_s_{c}": known(c, backward) for c in columns})
    filled = join_series(inside, carried, [*keys, "_bucket"], how="inner")
    return filled.withColumns({
        c: F.coalesce(f"_p_{c}", f"_b_{c}", f"_s_{c}", f"_n_{c}", F.lit(0.0)) for c in columns
    }).select(*df.columns)


def align_to_calendar(
    target: DataFrame, exogenous: DataFrame, columns: list[str], keys: Keys = ()
) -> DataFrame:
    """Bring outside influences onto the days of the target, gaps filled."""
    numeric = exogenous.select(*keys, "date", *[F.col(c).try_cast("double").alias(c) for c in columns])
    return fill_gaps(join_series(target, numeric, keys, ["date"]), columns, keys)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers where the value reads as one, null elsewhere; "not a number" is no number."""
    values = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in values.items()})


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def time_split(
    df: DataFrame, start: str, end: str, target: str | None = None, date: str = "date", check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows before ``start``, and rows from ``start`` to ``end``; neither side may be empty."""
    known = df if target is None else df.where(F.col(target).isNotNull())
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    train = known.where(F.col(date) < first)
    test = known.where(F.col(date).between(first, last))
    if check:
        for side, frame in (("training", train), ("test", test)):
            if frame.isEmpty():
                raise ValueError(f"the {side} period holds no usable rows")
    return train, test


def standardise(
    df: DataFrame, train: DataFrame, columns: list[str], keys: Keys = (), population: bool = False
) -> DataFrame:
    """Centre and scale by training statistics; a spread of zero, or of one value, scales by one."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = train.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[spread(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = attach(df, stats, keys).withColumns({
        c: (F.col(c) - F.col(f"_m_{c}"))
        / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
        for c in columns
    })
    return scaled.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def impute_median(
    df: DataFrame, train: DataFrame, columns: list[str], keys: Keys = ()
) -> DataFrame:
    """Replace nulls by the training median of the series."""
    medians = train.groupBy(*keys).agg(
        *[F.percentile(c, F.lit(0.5)).alias(f"_md_{c}") for c in columns]
    )
    filled = attach(df, medians, keys).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_md_{c}")) for c in columns}
    )
    return filled.drop(*[f"_md_{c}" for c in columns])
