"""Point-in-time joins: what was known about a key at the moment a question was asked."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column, close_to
from riskflow.operators.prefix import range_bounds, with_range
from riskflow.operators.views import Feature, Part, parts_of, utilisation

_SLOT = "_slot"


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    """Fail while planning, with the names that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; it has {df.columns}")


def spine(
    keys: DataFrame,
    key: str,
    as_ofs: Sequence[dt.date],
    as_of: str = "as_of",
    outcome: dt.date | None = None,
) -> DataFrame:
    """Ask about every key at each of the dates, which must precede the outcome."""
    late = [d for d in as_ofs if outcome is not None and d >= outcome]
    if late:
        raise ValueError(f"as-of dates {late} are not before the outcome {outcome}")
    dates = F.array(*[F.lit(d) for d in sorted(set(as_ofs))])
    return keys.select(key).distinct().select(key, F.explode(dates).alias(as_of))


def checked_spine(questions: DataFrame, as_of: str, outcome: str) -> DataFrame:
    """A spine with its own dates per row; a row at or after its outcome fails the job."""
    late = F.concat(F.lit("question at or after its outcome: "), F.col(as_of).cast("string"))
    guard = F.when(F.col(as_of) < F.col(outcome), F.col(as_of)).otherwise(F.raise_error(late))
    return questions.withColumn(as_of, guard)


def event_order(time: Column | str, tie: str | None = None) -> Column:
    """One orderable number per event.

    With a tie-break it is time and id in one decimal: a struct would order the
    same way but forces sort-based aggregation, a decimal stays in the hash map.
    """
    moment = as_column(time)
    if tie is None:
        return moment
    micros = F.unix_micros(moment.cast("timestamp")).cast("decimal(19,0)")
    return (micros * F.lit(Decimal(10**19)) + F.col(tie)).cast("decimal(38,0)")


def _collect(parts: Sequence[Part], order: Column) -> list[Column]:
    return [c.alias(n) for p in parts for n, c in p.collect(order).items()]


def _merge(parts: Sequence[Part]) -> list[Column]:
    return [c.alias(n) for p in parts for n, c in p.merge().items()]


def _results(features: Sequence[Feature]) -> list[Column]:
    return [f.result.alias(f.name) for f in features]


def point_in_time(
    events: DataFrame,
    questions: DataFrame,
    key: str,
    time: str,
    features: Sequence[Feature],
    as_ofs: Sequence[dt.date],
    as_of: str = "as_of",
    tie: str | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Features per (key, as-of) from events at or before the as-of date.

    ``as_ofs`` lists every date the questions use. The dates cut time into a few
    slots, so each event is read once and folded into (key, slot) before the
    shuffle, however many questions will see it; a question then merges the few
    slots that end by its date. Events after the last date never leave the scan.
    A question without a visible event is dropped unless ``keep_empty``.
    """
    require_columns(questions, [key, as_of], "the spine")
    dates = sorted(set(as_ofs))
    parts = parts_of(features)

    def slot(moment: str) -> Column:
        return sum((F.col(moment) > F.lit(d)).cast("int") for d in dates)

    folded = (
        events.where(F.col(time) <= F.lit(dates[-1]))
        .groupBy(key, slot(time).alias(_SLOT))
        .agg(*_collect(parts, event_order(time, tie)))
    )
    asked = questions.select(key, as_of).distinct().withColumn("_asked", slot(as_of))
    seen = asked.join(
        folded.withColumnRenamed(key, "_key"),
        (F.col(key) == F.col("_key")) & (F.col(_SLOT) <= F.col("_asked")),
        "left" if keep_empty else "inner",
    )
    return seen.groupBy(key, as_of).agg(*_merge(parts)).select(key, as_of, *_results(features))


def point_in_time_running(
    events: DataFrame,
    questions: DataFrame,
    key: str,
    time: str,
    features: Sequence[Feature],
    as_of: str = "as_of",
    tie: str | None = None,
    keep_empty: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """The same result when every question has a date of its own.

    Events and questions of a key are merged in time order and each question reads
    the running value. Time is cut into ranges, the window runs inside (key, range)
    and a key carries its state from range to range as one row, so a key that
    holds a third of all events is spread over all ranges.
    """
    require_columns(questions, [key, as_of], "the spine")
    parts = parts_of(features)
    if bounds is None:
        bounds = range_bounds(events, time)
    order = event_order(time, tie)
    width = F.col(time).cast("timestamp")

    facts = with_range(events, time, bounds, _SLOT).select(
        key,
        _SLOT,
        width.alias("_t"),
        F.lit(0).alias("_asks"),
        order.alias("_order"),
        *[p.value.alias(p.name) for p in parts],
    )
    asked = questions.select(key, as_of).distinct()
    marks = with_range(asked, as_of, bounds, _SLOT).select(
        key, _SLOT, F.col(as_of).cast("timestamp").alias("_t"), F.lit(1).alias("_asks"), as_of
    )
    both = facts.unionByName(marks, allowMissingColumns=True)

    def over(window) -> list[Column]:
        columns = []
        for p in parts:
            row = Part(p.name, p.kind, F.col(p.name))
            named = row.collect(F.col("_order")).items()
            columns += [c.over(window).alias(f"_now{n}") for n, c in named]
        return columns

    inside = Window.partitionBy(key, _SLOT).orderBy("_t", "_asks")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Only the question rows go on; the events were needed inside the window alone.
    now = both.select("*", *over(upto)).where("_asks = 1").select(
        key, _SLOT, as_of, *[f"_now{c}" for p in parts for c in p.columns]
    )

    folded = (
        with_range(events, time, bounds, _SLOT).groupBy(key, _SLOT).agg(*_collect(parts, order))
    )
    # One row per key and range on either side, so a key has few rows from here on.
    wanted = marks.select(key, _SLOT, "_asks").distinct()
    earlier = (
        Window.partitionBy(key).orderBy(_SLOT).rangeBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        folded.unionByName(wanted, allowMissingColumns=True)
        .select(
            key,
            _SLOT,
            "_asks",
            *[c.over(earlier).alias(f"_old{n}") for p in parts for n, c in p.merge().items()],
        )
        .where("_asks = 1")
        .drop("_asks")
    )
    met = now.join(carried, [key, _SLOT], "left").select(
        key,
        as_of,
        *[p.join_up(F.col(f"_old{p.name}"), F.col(f"_now{p.name}")).alias(p.name) for p in parts],
    )
    if not keep_empty:
        # Counting parts are null exactly where no event was visible.
        counted = [F.col(p.name).isNotNull() for p in parts]
        some = counted[0]
        for c in counted[1:]:
            some = some | c
        met = met.where(some)
    return met.select(key, as_of, *_results(features))


def latest(
    events: DataFrame,
    questions: DataFrame,
    key: str,
    time: str,
    features: Sequence[Feature],
    as_of: str = "as_of",
    tie: str | None = None,
) -> DataFrame:
    """The join that ignores the as-of date, kept to measure what that costs.

    Every question is kept, with or without events.
    """
    parts = parts_of(features)
    folded = events.groupBy(key).agg(*_collect(parts, event_order(time, tie)))
    made = folded.select(key, *_results(features))
    return made.join(questions.select(key, as_of), key, "right")


def attach_entities(
    made: DataFrame,
    entities: DataFrame,
    key: str,
    bill: str = "bill_latest",
    limit: str = "limit_bal",
) -> DataFrame:
    """Static attributes and the ratios that need them. Spark picks the join by size."""
    merged = made.join(entities, key, "left")
    return merged.withColumn("utilisation_latest", utilisation(bill, limit))


def disagreement(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Share of cells in which two feature tables differ, over their common keys."""
    other = right.select(*keys, *[F.col(c).alias(f"_other_{c}") for c in columns])
    pairs = left.select(*keys, *columns).join(other, list(keys))
    wrong = sum((~close_to(F.col(c), F.col(f"_other_{c}"))).cast("int") for c in columns)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.sum(wrong) / (F.count(F.lit(1)) * len(columns))).alias("corrupted_share"),
    )
