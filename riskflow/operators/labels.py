"""Outcomes that arrive late, and the decisions they belong to.

``outcome_at`` is when an outcome came to be, ``observed_at`` when it reached us.
An evaluation dated T may use a decision whose window had closed by T and a label
that had been reported by T.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import (
    count_where,
    days_before,
    instant,
    plus_days,
    ratio,
)
from riskflow.operators.asof import require_columns
from riskflow.operators.metrics import ranking
from riskflow.operators.sampling import observe

KEY = "application_id"
DECISION_COLUMNS = [KEY, "predicted_at", "probability", "prediction"]


def known_by(outcomes: DataFrame, as_of: dt.datetime | str | None) -> DataFrame:
    """Outcomes reported by ``as_of``, all of them without a date."""
    return outcomes if as_of is None else outcomes.where(F.col("observed_at") <= instant(as_of))


def matured(
    decisions: DataFrame, as_of: dt.datetime | str, window_days: float = catalog.WINDOW_DAYS
) -> DataFrame:
    """Decisions whose performance window had closed.

    The window is taken from the literal, so the bare column can prune files.
    """
    return decisions.where(F.col("predicted_at") <= instant(days_before(as_of, window_days)))


def join_labels(
    decisions: DataFrame,
    outcomes: DataFrame,
    as_of: dt.datetime | str,
    window_days: float = catalog.WINDOW_DAYS,
) -> DataFrame:
    """Decisions that can be scored at ``as_of``, with their labels. Both gates apply here,
    whatever the caller filtered."""
    require_columns(decisions, DECISION_COLUMNS, "the decisions")
    ready = matured(decisions, as_of, window_days).withColumn(
        "matures_at", plus_days("predicted_at", window_days)
    )
    return ready.join(known_by(outcomes, as_of), KEY)


def left_join_keyed(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """A left join that rows without a key pass by: they match nothing, and however
    many there are they would all meet in one task."""
    keyed = left.where(F.col(key).isNotNull()).join(right, key, "left")
    return keyed.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def join_counts(
    decisions: DataFrame,
    outcomes: DataFrame,
    as_of: dt.datetime | str,
    window_days: float = catalog.WINDOW_DAYS,
) -> DataFrame:
    """What the join at ``as_of`` left out and why, as one row from one left join.

    Declined rows without a label are censored, approved ones are still to come.
    """
    ready = F.col("predicted_at") <= instant(days_before(as_of, window_days))
    known = known_by(outcomes, as_of).select(KEY, F.lit(True).alias("_known"))
    rows = left_join_keyed(decisions.select(KEY, "prediction", ready.alias("_ready")), known)
    seen = F.col("_known").isNotNull()
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col("_ready")).alias("matured"),
        count_where(F.col("_ready") & seen).alias("observed"),
        count_where(F.col("_ready") & ~seen & (F.col("prediction") == 0)).alias("pending"),
        count_where(F.col("_ready") & ~seen & (F.col("prediction") == 1)).alias("censored"),
    )
    return counted.withColumns(
        {
            "coverage": ratio(F.col("observed"), F.col("matured")),
            "maturity": ratio(F.col("matured"), F.col("total")),
        }
    )


def unlabelled(
    decisions: DataFrame,
    outcomes: DataFrame,
    as_of: dt.datetime | str,
    window_days: float = catalog.WINDOW_DAYS,
) -> DataFrame:
    """Matured decisions without a reported label."""
    ready = matured(decisions, as_of, window_days)
    known = known_by(outcomes, as_of).select(KEY)
    keyed = ready.where(F.col(KEY).isNotNull()).join(known, KEY, "left_anti")
    return keyed.unionByName(ready.where(F.col(KEY).isNull()))


def join_ignoring_time(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The join on the key alone. It imports the future; kept to measure by how much."""
    return decisions.join(outcomes, KEY)


def covered(counts: DataFrame, floor: float = catalog.MIN_COVERAGE) -> DataFrame:
    """Report whether enough labels are in. Nothing acts on it: low coverage is normal."""
    return counts.withColumn("above_floor", F.col("coverage") >= F.lit(floor))


def censoring_frame(
    served: DataFrame,
    lag_days: Column,
    rate: float = catalog.HOLDOUT_RATE,
    window_days: float = catalog.WINDOW_DAYS,
    seed: int = catalog.SEED,
) -> DataFrame:
    """Which decisions will have an outcome, and when it is reported; null when never."""
    frame = observe(served, KEY, "prediction", rate, seed).withColumn(
        "matures_at", plus_days("predicted_at", window_days)
    )
    arrives = plus_days("matures_at", lag_days)
    return frame.withColumn("observed_at", F.when(F.col("observable"), arrives))


def first_reports(feed: DataFrame, key: str = KEY) -> DataFrame:
    """One row per key, the first report. Combined before the shuffle, so a key that is
    restated endlessly costs one row per task."""
    rest = [c for c in feed.columns if c != key]
    order = F.struct("observed_at", *[c for c in rest if c != "observed_at"])
    picked = feed.groupBy(key).agg(F.min(order).alias("_first"))
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def insert_if_absent(store: DataFrame, feed: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of the feed to append: first report wins, stored keys are never restated."""
    return first_reports(feed, key).join(store.select(key), key, "left_anti")


def maturity_slots(
    decisions: DataFrame,
    outcomes: DataFrame,
    offsets: Sequence[int] = tuple(catalog.MATURITY_OFFSETS),
    window_days: float = catalog.WINDOW_DAYS,
) -> DataFrame:
    """Each decision with the first as-of number at which it is matured, and labelled.

    The dates are ``offsets`` days after the first decision. One join serves all of
    them: a row counts from its slot on.
    """
    days = sorted(offsets)
    origin = decisions.agg(F.min("predicted_at").alias("_origin"))
    served = decisions.select(KEY, "predicted_at", "probability", "prediction")
    joined = left_join_keyed(served, outcomes.select(KEY, "observed_at", "label"))
    rows = joined.withColumn("_origin", origin.scalar())
    matures = plus_days("predicted_at", window_days)
    dates = [plus_days("_origin", d) for d in days]

    def slot(moment: Column) -> Column:
        return sum((moment > d).cast("int") for d in dates)

    ready = slot(matures)
    reported = slot(F.greatest(matures, F.col("observed_at")))
    return rows.select(
        "prediction",
        "probability",
        "label",
        ready.alias("ready_slot"),
        F.when(F.col("observed_at").isNotNull(), reported)
        .otherwise(F.lit(len(days)))
        .alias("label_slot"),
    )


def maturity_curve(
    decisions: DataFrame,
    outcomes: DataFrame,
    offsets: Sequence[int] = tuple(catalog.MATURITY_OFFSETS),
    window_days: float = catalog.WINDOW_DAYS,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Maturity, coverage, label count, default rate and average precision per as-of date.

    The rate and the precision are those of approved rows, as a dashboard shows
    them. Dates without a label are left out.
    """
    days = sorted(offsets)
    slots = maturity_slots(decisions, outcomes, days, window_days)
    # Folded to as many rows as there are slot pairs before any date is attached.
    folded = slots.groupBy("ready_slot", "label_slot", "prediction", "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    asked = F.inline(
        F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(d).alias("days")) for i, d in enumerate(days)])
    )
    spread = folded.select("*", asked)

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    ready = F.col("ready_slot") <= F.col("slot")
    seen = F.col("label_slot") <= F.col("slot")
    approved = seen & (F.col("prediction") == 0)
    counts = spread.groupBy("slot", "days").agg(
        rows(F.lit(True)).alias("total"),
        rows(ready).alias("matured"),
        rows(seen).alias("labels"),
        rows(approved).alias("approved_labels"),
        rows(approved & (F.col("label") == 1)).alias("approved_positives"),
    )
    # Equal scores fold first, so the copies per date are copies of a folded row.
    cells = (
        slots.where(f"label_slot < {len(days)} and prediction = 0")
        .groupBy("label_slot", "probability", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("label", "probability", "n", F.explode(
            F.sequence(F.col("label_slot"), F.lit(len(days) - 1))).alias("slot"))
    )
    precision = ranking(cells, "label", "probability", weight="n", by=["slot"], bounds=bounds)
    return (
        counts.where("labels > 0")
        .join(precision.select("slot", "pr_auc"), "slot", "left")
        .select(
            "days",
            "total",
            "matured",
            "labels",
            ratio(F.col("matured"), F.col("total")).alias("maturity"),
            ratio(F.col("labels"), F.col("matured")).alias("coverage"),
            ratio(F.col("approved_positives"), F.col("approved_labels"), None).alias(
                "observed_default_rate"
            ),
            F.col("pr_auc").alias("observed_pr_auc"),
        )
    )
