"""Settlement-clock arithmetic and calendar columns, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date format with a month name (ISO dates are the other one) and the seasons used as features.
NAMED_MONTH_FORMAT = "d-MMM-yyyy"
NAMED_MONTH_SHAPE = r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"
# Own choice: other shapes that are read when neither fits, month before day. A time of day may follow.
FREE_SHAPES = {
    r"^\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d", r"^\d{1,2}/\d{1,2}/\d{4}": "M/d/yyyy", r"^\d{8}": "yyyyMMdd",
    r"^\d{4}\.\d{1,2}\.\d{1,2}": "yyyy.M.d", r"^\d{1,2} [A-Za-z]{3} \d{4}": "d MMM yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}": "MMM d, yyyy",
}
TIME_SHAPES = {r"": "", r"[ T]\d{1,2}:\d{2}": " H:mm", r"[ T]\d{1,2}:\d{2}:\d{2}": " H:mm:ss"}
WINTER_MONTHS = (12, 1, 2)
SUMMER_MONTHS = (6, 7, 8)
PEAK_MONTHS = (11, 12, 1, 2)


def parse_stamp(text: Column, kind: T.DataType | None = None) -> Column:
    """Zone-less timestamp from text: day with a month name, ISO date, ISO timestamp, or one of the free shapes;
    else null. A column whose ``kind`` is a date or timestamp already is only cast.

    The shape decides the parser, because a format that does not match costs an exception per row. Where day and
    month cannot be told apart the month comes first, unless that is no month.
    """
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return text.cast("timestamp_ntz")
    trimmed = F.trim(text.cast("string"))
    read = lambda source, form: F.try_to_timestamp(source, F.lit(form)).cast("timestamp_ntz")
    free = F.lit(None).cast("timestamp_ntz")
    spaced = F.regexp_replace(trimmed, r"^(\S+)T(\d)", "$1 $2")
    for shape, form in FREE_SHAPES.items():
        for after, clock in TIME_SHAPES.items():
            value = read(spaced, form + clock)
            if form == "M/d/yyyy":
                value = F.coalesce(value, read(spaced, "d/M/yyyy" + clock))
            free = F.when(trimmed.rlike(f"{shape}{after}$"), value).otherwise(free)
    return F.when(trimmed.rlike(NAMED_MONTH_SHAPE), read(trimmed, NAMED_MONTH_FORMAT)).otherwise(
        F.when(trimmed.rlike(r"^\d{4}(-|$)"), trimmed.try_cast("timestamp_ntz")).otherwise(free)
    )


def settlement_stamp(date: Column, period: Column, minutes: int = 30, kind: T.DataType | None = None) -> Column:
    """Start of a numbered settlement period.

    Period 1 starts at midnight. Numbers beyond the last regular period are kept and spill into the
    next day; numbers below 1 give null.
    """
    number = period.try_cast("int")
    return F.when(
        number >= 1, F.timestamp_add("MINUTE", (number - 1) * minutes, parse_stamp(date, kind))
    )


def last_sunday(day: Column) -> Column:
    """Last Sunday of the month that contains ``day``."""
    end = F.last_day(day)
    return F.date_sub(end, F.weekday(F.date_add(end, 1)))


def expected_periods(day: Column) -> Column:
    """46 periods when the clock goes forward in March, 50 when it goes back in October, else 48."""
    changes = day == last_sunday(day)
    return (
        F.when(changes & (F.month(day) == 3), 46)
        .when(changes & (F.month(day) == 10), 50)
        .otherwise(48)
    )


def calendar_columns(day: Column) -> dict[str, Column]:
    """Calendar attributes of a date; weeks are ISO weeks and Monday is day 0."""
    month = F.month(day)
    return {
        "year": F.year(day),
        "month": month,
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "week_of_year": F.weekofyear(day),
        "quarter": F.quarter(day),
        "is_weekend": F.weekday(day) >= 5,
        "is_winter": month.isin(*WINTER_MONTHS),
        "is_summer": month.isin(*SUMMER_MONTHS),
        "is_peak_season": month.isin(*PEAK_MONTHS),
    }


SEASON_FLAGS = ("is_winter", "is_summer", "is_peak_season")


def add_calendar(df: DataFrame, date: str = "date", only: list[str] | None = None) -> DataFrame:
    """Add calendar attributes. Columns already present are kept, but season flags are always derived."""
    columns = calendar_columns(F.col(date))
    wanted = only or list(columns)
    return df.withColumns(
        {c: columns[c] for c in wanted if c in SEASON_FLAGS or c not in df.columns}
    )
