"""Timestamp repair, duplicates, gaps, steps, missing values and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.clock import parse_stamp, settlement_stamp
from meterloom.functions.names import CLOCK_COLUMNS
from meterloom.operators.quantiles import exact_quantiles, union_all
from meterloom.operators.series import Keys, attach, by_series, join_series, numbered
from meterloom.session import cut_lineage
from meterloom.sources.tables import require_columns, required

STAMP = "settlement_datetime"


def add_stamp(
    df: DataFrame,
    date: str = "settlement_date",
    period: str = "settlement_period",
    out: str = STAMP,
    minutes: int = 30,
) -> DataFrame:
    """Add the period start. Source columns stay as they are."""
    require_columns(df, date, period)
    return df.withColumn(out, settlement_stamp(F.col(date), F.col(period), minutes, df.schema[date].dataType))


def ensure_stamp(df: DataFrame, stamp: str = STAMP, minutes: int = 30) -> DataFrame:
    """Keep timestamps that parse, rebuild the rest from date and period, fail if one stays null."""
    if stamp not in df.columns:
        return add_stamp(df, out=stamp, minutes=minutes)
    value = parse_stamp(F.col(stamp), df.schema[stamp].dataType)
    if {"settlement_date", "settlement_period"} <= set(df.columns):
        kind = df.schema["settlement_date"].dataType
        rebuilt = settlement_stamp(F.col("settlement_date"), F.col("settlement_period"), minutes, kind)
        value = F.coalesce(value, rebuilt)
    return df.withColumn(stamp, required(value, f"{stamp} holds values that cannot be parsed"))


def audit_duplicates(
    df: DataFrame,
    stamp: str = STAMP,
    ordinal: str = "ordinal",
    keys: Keys = (),
    keep: list[str] | None = None,
    span: int = 1_000_000,
) -> DataFrame:
    """Rows whose timestamp occurs more than once, with group size and 1-based arrival number.

    A single timestamp may hold any share of the table, so rows are numbered in stretches of
    ``span`` ordinals instead of sorting a whole timestamp group.
    """
    preferred = [*CLOCK_COLUMNS, "nd", "tsd", "england_wales_demand"]
    shown = keep if keep is not None else [c for c in preferred if c in df.columns]
    group = [*keys, stamp]
    counted = numbered(
        df.select(*group, ordinal, *shown), group, [ordinal],
        F.floor(F.col(ordinal) / span), "_pos", "duplicate_group_count",
    )
    return counted.where("duplicate_group_count > 1").select(
        *group, *shown, "duplicate_group_count",
        (F.col("_pos") + 1).alias("duplicate_row_number"),
    )


def resolve_duplicates(
    df: DataFrame,
    stamp: str = STAMP,
    ordinal: str = "ordinal",
    keys: Keys = (),
    metadata: list[str] | None = None,
) -> DataFrame:
    """One row per timestamp: numeric measurements averaged, all else first non-null in arrival order.

    One aggregation, partial before the shuffle, also yields ``duplicate_count``.
    """
    require_columns(df, stamp, ordinal)
    described = set(CLOCK_COLUMNS if metadata is None else metadata)
    group = [*keys, stamp]

    def resolved(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.NumericType) and field.name not in described:
            return F.avg(c).alias(field.name)
        return F.min_by(c, F.when(c.isNotNull(), F.col(ordinal))).alias(field.name)

    fields = [f for f in df.schema if f.name not in (*group, ordinal)]
    checked = df.withColumn(stamp, required(F.col(stamp), f"{stamp} is missing on some rows"))
    return checked.groupBy(*group).agg(
        *map(resolved, fields), F.count(F.lit(1)).alias("duplicate_count")
    )


def distinct_stamps(df: DataFrame, stamp: str = STAMP, keys: Keys = ()) -> DataFrame:
    """Known timestamps of each series, once each; written, since gaps and steps read them several times."""
    return cut_lineage(df.select(*keys, F.col(stamp)).where(F.col(stamp).isNotNull()).distinct())


def timestamp_gaps(df: DataFrame, stamp: str = STAMP, keys: Keys = ()) -> DataFrame:
    """Expected timestamps, at the commonest interval between first and last, that never occur.

    The expected grid is generated day by day, so no task expands the whole range.
    """
    seen = distinct_stamps(df, stamp, keys)
    steps = _step_counts(seen, stamp, keys, True).groupBy(*keys).agg(_commonest().alias("_step"))
    ends = seen.groupBy(*keys).agg(F.min(stamp).alias("_first"), F.max(stamp).alias("_last"))
    days = attach(ends, steps, keys).withColumn("_day", F.explode(F.sequence(
        F.to_date("_first"), F.to_date("_last"), F.expr("interval 1 day")
    )))
    # index of the first grid point at or after midnight, and of the last one before the next midnight
    day = F.expr("timestampdiff(MICROSECOND, _first, cast(_day as timestamp_ntz))")
    span = F.expr("timestampdiff(MICROSECOND, _first, _last)")
    before = lambda micros: F.expr(f"({micros}) div _step")
    grid = (
        days.withColumns({"_start": day, "_span": span, "_step": F.nullif(F.col("_step"), F.lit(0))})
        .withColumns({
            "_low": F.greatest(before("_start + _step - 1"), F.lit(0)),
            "_high": F.least(before("_start + 86400000000 - 1"), before("_span")),
        })
        .where("_low <= _high and _start + 86400000000 > 0")
        .withColumn("_i", F.explode(F.sequence("_low", "_high")))
        .select(*keys, F.expr("timestampadd(MICROSECOND, _i * _step, _first)").alias(stamp))
    )
    return join_series(grid, seen, keys, [stamp], "left_anti")


def step_differences(
    df: DataFrame, stamp: str = STAMP, keys: Keys = (), distinct: bool = False
) -> DataFrame:
    """Microseconds between consecutive distinct timestamps (``distinct``: the rows are so already).

    Differences are taken inside a minute; the first timestamp of a minute looks up the last one of the
    preceding minute that has any: of its day, or else of the last day before. So a task holds the stamps of one minute, the
    minutes of one day, or one row per day of a series, which the calendar bounds.
    """
    seen = (df if distinct else distinct_stamps(df, stamp, keys)).withColumn("_part", F.date_trunc("minute", stamp))
    per_part = seen.groupBy(*keys, "_part").agg(F.max(stamp).alias("_part_last")).withColumn("_day", F.date_trunc("day", "_part"))
    per_day = per_part.groupBy(*keys, "_day").agg(F.max("_part_last").alias("_day_last")).select(
        *keys, "_day", F.lag("_day_last").over(by_series(keys, "_day")).alias("_from_days"))
    within = F.lag("_part_last").over(by_series([*keys, "_day"], "_part"))
    carried = join_series(per_part.withColumn("_within", within), per_day, keys, ["_day"], "inner").select(
        *keys, "_part", F.coalesce("_within", "_from_days").alias("_carried"))
    inside = F.lag(stamp).over(Window.partitionBy(*keys, "_part").orderBy(stamp))
    return (
        join_series(seen.withColumn("_previous", inside), carried, keys, ["_part"], "inner")
        .withColumn("_previous", F.coalesce("_previous", "_carried"))
        .where("_previous is not null")
        .select(*keys, stamp, F.expr(f"timestampdiff(MICROSECOND, _previous, `{stamp}`)").alias("step_micros"))
    )


def _step_counts(df: DataFrame, stamp: str, keys: Keys, distinct: bool) -> DataFrame:
    return step_differences(df, stamp, keys, distinct).groupBy(*keys, "step_micros").agg(
        F.count(F.lit(1)).alias("_times")
    )


def _commonest() -> Column:
    return F.max_by("step_micros", F.struct(F.col("_times"), -F.col("step_micros")))


def step_summary(
    df: DataFrame, stamp: str = STAMP, keys: Keys = (), distinct: bool = False
) -> DataFrame:
    """Commonest (smallest on ties), smallest and largest interval, and a label when it never varies."""
    micros = _step_counts(df, stamp, keys, distinct).groupBy(*keys).agg(
        _commonest().alias("_common"), F.min("step_micros").alias("_low"), F.max("step_micros").alias("_high")
    )
    seconds = lambda c: F.col(c) / F.lit(1e6)
    exact = F.regexp_replace((F.col("_common") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(30,6)").cast("string"), r"\.?0+$", "")
    whole = F.when(F.col("_common") % 1_000_000 == 0, F.expr("_common div 1000000").cast("string")).otherwise(exact)
    return micros.select(
        *keys, seconds("_common").alias("most_common_seconds"), seconds("_low").alias("minimum_seconds"),
        seconds("_high").alias("maximum_seconds"),
        F.when(F.col("_low") == F.col("_high"), F.concat(whole, F.lit(" s"))).alias("frequency"),
    )


def datetime_shares(df: DataFrame, ordinal: str, columns: list[str] | None = None, sample_size: int = 1000) -> DataFrame:
    """For each text column, how many of its first known values (in the order of ``ordinal``) read as a timestamp.

    All columns are sampled in one job: their values are stacked and the first of each column are kept by every task
    before they meet. The sample is part of the rule, not a shortcut.
    """
    texts = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != ordinal]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in texts])).alias("_e")
    stacked = df.select(F.col(ordinal).alias("_o"), cells).select("_o", "_e.*").where("value is not null")
    first = F.row_number().over(Window.partitionBy("column").orderBy("_o"))
    sample = stacked.withColumn("_place", first).where(F.col("_place") <= sample_size)
    return sample.groupBy("column").agg(
        F.count(F.lit(1)).alias("sampled"), F.count(parse_stamp(F.col("value"))).alias("parsed"))


def detect_datetime_columns(
    df: DataFrame, sample_size: int = 1000, share: float = 0.8, known: str = STAMP, ordinal: str | None = None
) -> list[str]:
    """Columns that are dates already, or text of which most of a small sample parses as one.

    A known stamp column comes first. Without ``ordinal`` the sample follows the order in which rows are read.
    """
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    numbered_ = df if ordinal else df.withColumn("_read", F.monotonically_increasing_id())
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (ordinal, known)]
    shares = datetime_shares(numbered_, ordinal or "_read", texts, sample_size).collect() if texts else []
    read = {r.column for r in shares if r.parsed >= share * r.sampled}
    found = [f.name for f in df.schema if f.name != known and (isinstance(f.dataType, dates) or f.name in read)]
    return ([known] if known in df.columns else []) + found


# Own choice: size of the sketches. Twelve bits count distinct values to 1.6 % (one deviation), 800 items know ranks to 0.5 %.
DISTINCT_BITS = 12
RANK_ITEMS = 800


def sketches(df: DataFrame, columns: list[str], keys: Keys = ()) -> DataFrame:
    """Mergeable sketches of every column in one pass: ``_rows``, and per column counts, distinct values and, for numbers,
    ranks. A few kilobytes per group, whatever its rows; groups are added up with :func:`merged_sketches`."""
    numbers = numeric_fields(df, columns)
    plain = lambda c: F.col(c) if c in numbers and numbers[c] != "double" else F.col(c).cast("string")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.hll_sketch_agg(plain(c), F.lit(DISTINCT_BITS)).alias(f"_d_{c}") for c in columns],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(RANK_ITEMS)).alias(f"_q_{c}") for c in numbers])


def numeric_fields(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The numeric ones of the columns: ``double`` for fractions, ``long`` for whole numbers."""
    return {f.name: "double" if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else "long"
            for f in df.schema if f.name in columns and isinstance(f.dataType, T.NumericType)}


def merged_sketches(parts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Sketches of unions of groups from sketches of the groups."""
    of = lambda prefix: [c for c in parts.columns if c.startswith(prefix)]
    return parts.groupBy(*keys).agg(
        F.sum("_rows").alias("_rows"), *[F.sum(c).alias(c) for c in of("_n_")],
        *[F.hll_union_agg(c).alias(c) for c in of("_d_")], *[F.kll_merge_agg_double(c).alias(c) for c in of("_q_")])


def sketch_profile(merged: DataFrame, columns: list[str], probs: dict[str, float], keys: Keys = ()) -> DataFrame:
    """Counts, estimated distinct values and estimated quantiles of every column, from its sketches."""
    numbers = [c for c in columns if f"_q_{c}" in merged.columns]
    quantile = lambda c, p: F.when(F.col(f"_n_{c}") > 0, F.kll_sketch_get_quantile_double(f"_q_{c}", F.lit(p))) if c in numbers else F.lit(None).cast("double")
    stacked = merged.select(*keys, "_rows", _stack(columns, lambda c: [
        F.col(f"_n_{c}").alias("non_null_count"), F.hll_sketch_estimate(f"_d_{c}").alias("unique_estimate"),
        *[quantile(c, p).alias(name) for name, p in probs.items()]]))
    return stacked.select(*keys, "_e.*", (F.col("_rows") - F.col("_e.non_null_count")).alias("missing_count"))


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and share of every column, from one pass."""
    columns = columns or df.columns
    tallied = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return tallied.select("_rows", _stack(columns, lambda c: [F.col(c).alias("missing_count")])).select(
        "_e.column", "_e.missing_count", _percent(F.col("_e.missing_count"), F.col("_rows")).alias("missing_pct")
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)


def _stack(columns: list[str], fields) -> Column:
    """One row per column name with its fields, from a single wide row."""
    return F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *fields(c)) for c in columns])).alias("_e")


def column_profile(df: DataFrame, ordinal: str, columns: list[str] | None = None) -> DataFrame:
    """Type, counts, distinct values and first example of every column.

    Counts and examples come from one pass; distinct values from one pruned scan per column, so a
    columnar source is read once more in total and rows are not multiplied by the column count.
    """
    columns = columns or [c for c in df.columns if c != ordinal]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    basics = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(c)).alias(f"_n_{c}") for c in columns],
        *[
            F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(f"_e_{c}")
            for c in columns
        ],
    )
    stacked = basics.select("_rows", _stack(columns, lambda c: [
        F.lit(types[c]).alias("dtype"),
        F.col(f"_n_{c}").alias("non_null_count"),
        F.col(f"_e_{c}").alias("example_value"),
    ])).select("_rows", "_e.*")
    distinct = union_all([
        df.select(F.col(c)).where(F.col(c).isNotNull()).distinct()
        .agg(F.count(F.lit(1)).alias("unique_count")).withColumn("column", F.lit(c))
        for c in columns
    ])
    missing = F.col("_rows") - F.col("non_null_count")
    return stacked.join(distinct, "column").select(
        "column", "dtype", "non_null_count", missing.alias("missing_count"),
        _percent(missing, F.col("_rows")).alias("missing_pct"), "unique_count", "example_value",
    )


def duplicate_row_counts(df: DataFrame, date: str, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row, and rows whose date occurs more than once."""
    columns = columns or df.columns
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times")).agg(
        F.sum(F.col("_times") - 1).alias("duplicate_rows"), F.sum("_times").alias("rows")
    )
    dates = df.groupBy(date).agg(F.count(F.lit(1)).alias("_times")).agg(
        F.coalesce(F.sum(F.when(F.col("_times") > 1, F.col("_times"))), F.lit(0)).alias("repeated_date_rows")
    )
    return attach(rows, dates, [])


def null_map(df: DataFrame, bucket: Column, columns: list[str], name: str = "bucket") -> DataFrame:
    """Share of nulls per time bucket and column."""
    shares = df.groupBy(bucket.alias(name)).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]
    )
    return shares.unpivot([name], columns, "column", "missing_share")


def iqr_bounds(df: DataFrame, value: str, keys: Keys = (), factor: float = 1.5) -> DataFrame:
    """Quartile fences of a column."""
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75}, keys)
    reach = (F.col("q3") - F.col("q1")) * factor
    return quartiles.withColumns({"lower": F.col("q1") - reach, "upper": F.col("q3") + reach})


def iqr_outliers(df: DataFrame, value: str, keys: Keys = (), factor: float = 1.5) -> DataFrame:
    """Rows strictly outside the fences."""
    fences = cut_lineage(iqr_bounds(df, value, keys, factor).select(*keys, "lower", "upper"))
    c = F.col(value)
    return attach(df, fences, keys).where((c < F.col("lower")) | (c > F.col("upper")))
