"""Feature definitions as mergeable aggregates.

A feature is declared once, as row-level columns plus the way their partial
results combine. The same declaration then serves a plain ``groupBy``, a two-step
aggregation over time intervals and a running window, and all of them combine
before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column, at_least, finite, ratio

SUM, MAX, MIN, LATEST, EARLIEST = "sum", "max", "min", "latest", "earliest"


@dataclass(frozen=True)
class Part:
    """A partial result: a row-level value and the rule that merges two of them."""

    name: str
    kind: str
    value: Column

    @property
    def columns(self) -> list[str]:
        at = [f"{self.name}__at"] if self.kind in (LATEST, EARLIEST) else []
        return [self.name, *at]

    def collect(self, order: Column) -> dict[str, Column]:
        """Aggregates over raw rows; ``order`` must be unique per key."""
        known = F.when(self.value.isNotNull(), order)
        return self._aggregates(self.value, known)

    def merge(self) -> dict[str, Column]:
        """Aggregates over partial results."""
        at = F.col(f"{self.name}__at") if len(self.columns) > 1 else F.lit(None)
        return self._aggregates(F.col(self.name), at)

    def _aggregates(self, value: Column, at: Column) -> dict[str, Column]:
        if self.kind == SUM:
            return {self.name: F.sum(value)}
        if self.kind == MAX:
            return {self.name: F.max(value)}
        if self.kind == MIN:
            return {self.name: F.min(value)}
        if self.kind == LATEST:
            return {self.name: F.max_by(value, at), f"{self.name}__at": F.max(at)}
        return {self.name: F.min_by(value, at), f"{self.name}__at": F.min(at)}

    def join_up(self, before: Column, now: Column) -> Column:
        """Merge an earlier and a later partial result that sit in one row."""
        if self.kind == SUM:
            return F.when(
                before.isNotNull() | now.isNotNull(),
                F.coalesce(before, F.lit(0)) + F.coalesce(now, F.lit(0)),
            )
        if self.kind == MAX:
            return F.greatest(before, now)
        if self.kind == MIN:
            return F.least(before, now)
        return F.coalesce(now, before) if self.kind == LATEST else F.coalesce(before, now)


@dataclass(frozen=True)
class Feature:
    """A named result computed from merged parts."""

    name: str
    parts: Sequence[Part]
    result: Column = field(repr=False)


def _simple(name: str, kind: str, value: Column) -> Feature:
    part = Part(f"_{name}", kind, value)
    return Feature(name, [part], F.col(part.name))


def count_of(name: str, value: Column | str) -> Feature:
    return _counted(name, as_column(value).isNotNull())


def count_when(name: str, condition: Column) -> Feature:
    return _counted(name, condition)


def _counted(name: str, condition: Column) -> Feature:
    part = Part(f"_{name}", SUM, F.when(condition, 1).otherwise(0).cast("bigint"))
    return Feature(name, [part], F.coalesce(F.col(part.name), F.lit(0)))


def latest(name: str, value: Column | str) -> Feature:
    """Newest value that is not null."""
    return _simple(name, LATEST, as_column(value))


def maximum(name: str, value: Column | str) -> Feature:
    return _simple(name, MAX, as_column(value))


def total(name: str, value: Column | str) -> Feature:
    return _simple(name, SUM, as_column(value))


def mean(name: str, value: Column | str) -> Feature:
    value = as_column(value)
    top = Part(f"_{name}_sum", SUM, value)
    bottom = Part(f"_{name}_n", SUM, F.when(value.isNotNull(), 1).otherwise(0).cast("bigint"))
    return Feature(name, [top, bottom], ratio(F.col(top.name), F.col(bottom.name), empty=None))


def trend(name: str, value: Column | str) -> Feature:
    """Newest minus oldest value."""
    value = as_column(value)
    last = Part(f"_{name}_last", LATEST, value)
    first = Part(f"_{name}_first", EARLIEST, value)
    return Feature(name, [last, first], F.col(last.name) - F.col(first.name))


def parts_of(features: Sequence[Feature]) -> list[Part]:
    return [p for f in features for p in f.parts]


def event_features(
    time: str, status: str = "pay_status", bill: str = "bill_amt", pay: str = "pay_amt"
) -> list[Feature]:
    """The repayment-history view over a window of statements.

    The payment ratio is averaged per statement, which separates a steady payer
    from one large payment, and a ratio of sums would not.
    """
    share = finite(F.col(pay).cast("double") / at_least(F.col(bill), 1).cast("double"))
    return [
        count_of("observed_months", time),
        latest("pay_status_latest", status),
        maximum("pay_status_max", status),
        count_when("months_delinquent", F.col(status) > 0),
        latest("bill_latest", bill),
        mean("bill_mean", bill),
        trend("bill_trend", bill),
        latest("pay_amt_latest", pay),
        mean("pay_amt_mean", pay),
        mean("payment_ratio_mean", share),
    ]


EVENT_FEATURES = [
    "observed_months",
    "pay_status_latest",
    "pay_status_max",
    "months_delinquent",
    "bill_latest",
    "bill_mean",
    "bill_trend",
    "pay_amt_latest",
    "pay_amt_mean",
    "payment_ratio_mean",
]


def utilisation(bill: str, limit: str) -> Column:
    """Newest balance against the limit, which counts as 1 at least."""
    return F.col(bill).cast("double") / at_least(F.col(limit), 1).cast("double")
