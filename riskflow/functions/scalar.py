"""Column functions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = float(2**32)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def only_row(df: DataFrame) -> Column:
    """The one row of a frame as a struct: a scalar subquery that runs once."""
    return df.select(F.struct(*df.columns)).scalar()


def hash_uniform(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone.

    md5 rather than an engine hash, so that a retried task, another cluster or
    another engine assigns the same row to the same side.
    """
    text = F.concat(F.lit(f"{seed}:"), as_column(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(HASH_RANGE)


def at_least(value: Column | str, floor: float) -> Column:
    """Clip from below. ``greatest`` alone would turn a null into the floor."""
    value = as_column(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def within(value: Column | str, low: float, high: float) -> Column:
    """Clip on both sides, null stays null."""
    value = as_column(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def finite(value: Column) -> Column:
    """Infinities and NaN become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Division as double, with a fixed answer where the denominator is zero."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    result = F.when(bottom != 0, top / bottom)
    return result if empty is None else F.coalesce(result, F.lit(float(empty)))


def count_where(condition: Column) -> Column:
    """Rows where the condition holds, 0 (not null) for an empty group."""
    return F.count(F.when(condition, F.lit(1)))


def close_to(left: Column, right: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equality with tolerance; a missing side never matches."""
    gap = F.abs(left.cast("double") - right.cast("double"))
    return F.coalesce(gap <= F.lit(atol) + F.lit(rtol) * F.abs(right.cast("double")), F.lit(False))


def band(value: Column | str, edges: Sequence[int]) -> Column:
    """``lo-hi`` label of the half-open interval that holds the value, else null."""
    value = as_column(value)
    label = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        hit = (value >= low) & (value < high)
        text = F.lit(f"{low}-{high}")
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return label


def instant(value: dt.datetime | str) -> Column:
    """A wall-clock literal without time zone, as the tables store their times."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def days_before(value: dt.datetime | str, days: float) -> dt.datetime:
    """``value - days`` on the driver, so the column side of a filter stays bare."""
    moment = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment - dt.timedelta(days=days)


def plus_days(moment: Column | str, days: Column | float) -> Column:
    """Add days, fractions included."""
    amount = days if isinstance(days, Column) else F.lit(float(days))
    return as_column(moment) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (amount * 86400).cast("decimal(18,6)")
    )


def seconds_between(end: Column, start: Column) -> Column:
    """Elapsed seconds as double, for either timestamp type."""
    span = (end.cast("timestamp").cast("double")) - (start.cast("timestamp").cast("double"))
    return span
