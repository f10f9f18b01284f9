"""Recursions over the days of a series as folds inside the JVM.

A fold walks an array of days and carries a struct of arrays along: histories, seasonal states, shocks. One series is
one row, bounded by the calendar, so a table of series is folded by a plain projection: no shuffle, no Python, and a
lost executor repeats its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.series import Keys


def total(values: Column) -> Column:
    """Sum of an array without nulls, in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    """Mean of the known entries of an array; null if there are none."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, total(known) / F.size(known))


def pushed(values: Column, value: Column, keep: int | None = None) -> Column:
    """The array with a value added behind and, with ``keep``, only its last entries."""
    longer = F.concat(values, F.array(value))
    if keep is None:
        return longer
    return F.slice(longer, F.greatest(F.size(longer) - keep, F.lit(0)) + 1, keep)


def back(values: Column, steps: int) -> Column:
    """The entry ``steps`` before the end, 1 being the last; null beyond the start."""
    return F.get(values, F.size(values) - steps)


def last(values: Column, length: int) -> Column:
    """The last ``length`` entries, or as many as there are."""
    return F.slice(values, F.greatest(F.size(values) - length, F.lit(0)) + 1, length)


def weighted(weights: Sequence[Column], values: Sequence[Column]) -> Column:
    return reduce(Column.__add__, (w * v for w, v in zip(weights, values, strict=True)))


def fold(items: Column, start: dict[str, Column], types: dict[str, str], step: Callable[[Column, Column], dict[str, Column] | Column]) -> Column:
    """Run ``step`` over an array; the state is a struct of ``types``, and so is the result. A step gives the parts of the
    next state by name, or the struct itself."""
    def packed(parts: dict[str, Column] | Column) -> Column:
        # Fields are cast one by one: a cast of the whole struct would copy its arrays at every step.
        return parts if isinstance(parts, Column) else F.struct(*[parts[name].cast(t).alias(name) for name, t in types.items()])

    return F.aggregate(items, packed(start), lambda state, item: packed(step(state, item)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(items: Column, length: int) -> Column:
    """An array cut into arrays of ``length`` entries; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / length).cast("int"))
    cut = F.transform(starts, lambda i: F.slice(items, i * length + 1, length))
    return F.filter(cut, lambda part: F.size(part) > 0)


def days_of(df: DataFrame, keys: Keys, columns: Sequence[str], name: str = "_days") -> DataFrame:
    """One row per series with its days as an array of structs, in order of ``date``."""
    entry = F.struct("date", *[c for c in columns if c != "date"])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))
