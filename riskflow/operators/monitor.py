"""Windowed views of the prediction log, and the alerts that watch them.

Sliding windows are built from panes of one slide each: rows fold into panes once,
and only panes are copied into the windows that cover them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import as_column, count_where, only_row, ratio
from riskflow.operators.prefix import exact_quantiles, ordered_prefix
from riskflow.operators.views import Feature, count_of, count_when, mean, parts_of


def pane_start(time: Column | str, minutes: int) -> Column:
    """Start of the pane that holds a moment; panes are aligned to the epoch."""
    seconds = F.floor(F.unix_micros(as_column(time).cast("timestamp")) / 1_000_000)
    start = seconds - F.pmod(seconds, F.lit(minutes * 60))
    return F.timestamp_seconds(start)


def sliding(
    df: DataFrame,
    time: str,
    features: Sequence[Feature],
    size: int,
    slide: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Features per window of ``size`` minutes that starts every ``slide`` minutes."""
    if size % slide:
        raise ValueError("the window must be a multiple of the slide")
    parts = parts_of(features)
    order = F.col(time)
    panes = df.groupBy(*by, pane_start(time, slide).alias("_pane")).agg(
        *[c.alias(n) for p in parts for n, c in p.collect(order).items()]
    )
    if size == slide:
        merged = panes.withColumnRenamed("_pane", "_start")
    else:
        back = F.explode(F.sequence(F.lit(0), F.lit(size // slide - 1))).alias("_back")
        start = F.timestamp_seconds(
            F.unix_seconds("_pane") - F.col("_back").cast("bigint") * (slide * 60)
        )
        merged = (
            panes.select("*", back)
            .groupBy(*by, start.alias("_start"))
            .agg(*[c.alias(n) for p in parts for n, c in p.merge().items()])
        )
    return merged.select(
        *by,
        F.col("_start").cast("timestamp_ntz").alias("window_start"),
        *[f.result.alias(f.name) for f in features],
    )


def request_rate(df: DataFrame, time: str, size: int = 5, slide: int = 1) -> DataFrame:
    """Requests per second."""
    made = sliding(df, time, [count_of("requests", time)], size, slide)
    return made.withColumn("rate", F.col("requests") / F.lit(size * 60.0))


def error_ratio(df: DataFrame, time: str, status: str, size: int = 5, slide: int = 1) -> DataFrame:
    """Share of failed requests, 0 without failures."""
    made = sliding(
        df,
        time,
        [count_of("requests", time), count_when("errors", F.col(status) >= 500)],
        size,
        slide,
    )
    return made.withColumn("error_ratio", ratio(F.col("errors"), F.col("requests")))


def mean_score(df: DataFrame, time: str, score: str, size: int = 15, slide: int = 5) -> DataFrame:
    made = sliding(df, time, [count_of("predictions", time), mean("mean_score", score)], size, slide)
    return made


def flagged_share(
    df: DataFrame, time: str, score: str, cutoff: float = 0.5, size: int = 5, slide: int = 5
) -> DataFrame:
    """Share of scores above a cutoff, the cutoff excluded."""
    made = sliding(
        df,
        time,
        [count_of("predictions", score), count_when("flagged", F.col(score) > cutoff)],
        size,
        slide,
    )
    return made.withColumn("flagged_share", ratio(F.col("flagged"), F.col("predictions")))


def window_quantiles(
    df: DataFrame,
    time: str,
    value: str,
    probs: dict[str, float],
    size: int = 5,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles per window: the value at rank ceil(q * n), however many rows a window has.

    Equal values fold before the shuffle and a window is cut into value ranges, so a
    busy one is neither a buffer nor a task.
    """
    paned = df.select(pane_start(time, size).alias("_start"), F.col(value).alias("_v"))
    cells = ordered_prefix(paned, "_v", {"n": F.lit(1)}, ["_start"], bounds=bounds)
    picks = []
    for name, q in probs.items():
        rank = F.greatest(F.ceil(F.lit(float(q)) * F.col("all_n")), F.lit(1))
        hit = (F.col("cum_n") - F.col("n") < rank) & (rank <= F.col("cum_n"))
        picks.append(F.max(F.when(hit, F.col("_v"))).alias(name))
    found = cells.groupBy("_start").agg(*picks)
    # A window without a value is a window still.
    made = paned.groupBy("_start").agg(F.count("_v").alias("n")).join(found, "_start", "left")
    return made.select(F.col("_start").cast("timestamp_ntz").alias("window_start"), "n", *probs)


def score_histogram(
    df: DataFrame, score: str, bounds: Sequence[float] = tuple(catalog.SCORE_BOUNDS)
) -> DataFrame:
    """Cumulative counts per upper bound, the bound included, from one pass."""
    counted = df.agg(
        *[count_where(F.col(score) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(score).alias("total"),
    )
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative"), F.col("total"))
        for i, b in enumerate(bounds)
    ]
    return counted.select(F.inline(F.array(*rows)))


def histogram_quantiles(histogram: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles from cumulative counts, straight lines inside a bucket.

    The input has one row per bound, so the window holds a dozen rows.
    """
    order = Window.partitionBy("total").orderBy("le")
    steps = histogram.select(
        "*",
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("_low"),
        F.coalesce(F.lag("cumulative").over(order), F.lit(0)).alias("_before"),
    )
    picks = []
    for name, q in probs.items():
        rank = F.lit(float(q)) * F.col("total")
        inside = (F.col("_before") < rank) & (rank <= F.col("cumulative"))
        width = F.col("cumulative") - F.col("_before")
        at = F.col("_low") + (F.col("le") - F.col("_low")) * ((rank - F.col("_before")) / width)
        picks.append(F.max(F.when(inside, at)).alias(name))
    return steps.agg(*picks)


def calendar(df: DataFrame, time: str, step: int) -> DataFrame:
    """Every ``step`` minutes from the first row to the last, with or without rows.

    Long spans are laid out day by day: no row holds a long array, and the days are
    dealt out, so a stray time far away does not leave all minutes to one task.
    """
    ends = df.agg(
        F.unix_seconds(pane_start(F.min(time), step)).alias("_a"),
        F.unix_seconds(pane_start(F.max(time), step)).alias("_z"),
    )
    day = 86_400
    days = ends.select(
        "*", F.explode(F.sequence(F.col("_a"), F.col("_z"), F.lit(day))).alias("_day")
    )
    last = F.least(F.col("_day") + day - step * 60, F.col("_z"))
    moments = days.repartition("_day").select(F.explode(F.sequence(F.col("_day"), last, F.lit(step * 60))).alias("_s"))
    return moments.select(F.timestamp_seconds("_s").cast("timestamp_ntz").alias("window_start"))


def silent_windows(df: DataFrame, time: str, size: int = 15, step: int = 5) -> DataFrame:
    """Count per window, windows without a row included: there the absence is the alert."""
    counts = sliding(df, time, [count_of("predictions", time)], size, step)
    return (
        calendar(df, time, step)
        .join(counts, "window_start", "left")
        .select("window_start", F.coalesce("predictions", F.lit(0)).alias("predictions"))
        .withColumn("silent", F.col("predictions") == 0)
    )


def sustained(
    evaluations: DataFrame,
    condition: str,
    step: int | Column,
    hold: int | Column,
    time: str = "window_start",
    by: Sequence[str] = (),
) -> DataFrame:
    """Stretches in which a condition held at every evaluation for ``hold`` minutes.

    Takes one row per evaluation, ``step`` minutes apart. Time is cut into days
    before rows are numbered, so a long history of one rule is spread over the
    tasks; stretches that touch at midnight meet again in the fold that follows.
    """
    by = list(by)
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    true = evaluations.where(F.col(condition)).select(
        *by,
        seconds.alias("_s"),
        (as_column_or_literal(step) * 60).alias("_step"),
        as_column_or_literal(hold).alias("_hold"),
    )
    daily = true.withColumn("_day", F.floor(F.col("_s") / 86_400))
    order = Window.partitionBy(*by, "_day").orderBy("_s")
    # Consecutive evaluations have the same difference between time and row number.
    island = F.col("_s") - F.row_number().over(order) * F.col("_step")
    parts = (
        daily.withColumn("_island", island)
        .groupBy(*by, "_day", "_island")
        .agg(
            F.min("_s").alias("_a"),
            F.max("_s").alias("_z"),
            F.count(F.lit(1)).alias("_n"),
            F.max("_step").alias("_step"),
            F.max("_hold").alias("_hold"),
        )
    )
    # Few rows per day from here on.
    line = Window.partitionBy(*by).orderBy("_a")
    breaks = F.when(F.col("_a") - F.lag("_z").over(line) == F.col("_step"), 0).otherwise(1)
    joined = parts.withColumn("_break", breaks).withColumn("_stretch", F.sum("_break").over(line))
    found = joined.groupBy(*by, "_stretch").agg(
        F.min("_a").alias("_a"),
        F.max("_z").alias("_z"),
        F.sum("_n").alias("evaluations"),
        F.max("_hold").alias("_hold"),
    )
    minutes = ((F.col("_z") - F.col("_a")) / 60).cast("bigint")
    return found.select(
        *by,
        F.timestamp_seconds("_a").cast("timestamp_ntz").alias("started_at"),
        F.timestamp_seconds("_z").cast("timestamp_ntz").alias("ended_at"),
        "evaluations",
        minutes.alias("minutes"),
        (minutes >= F.col("_hold")).alias("fired"),
    )


def as_column_or_literal(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class AlertRule:
    """A watched value: evaluated every ``step`` minutes over ``size`` minutes, it fires
    after ``hold`` minutes outside its limits."""

    name: str
    severity: str
    value: str
    size: int
    step: int
    hold: int
    above: float | None = None
    below: float | None = None
    no_data_alerts: bool = False

    def breached(self) -> Column:
        value = F.col(self.value).cast("double")
        hit = F.lit(False)
        if self.above is not None:
            hit = hit | (value > self.above)
        if self.below is not None:
            hit = hit | (value < self.below)
        return F.coalesce(hit, F.lit(self.no_data_alerts))


# Limits, windows and holds of the four rules.
ALERTS = [
    AlertRule("error_rate", "critical", "error_ratio", 5, 1, 5, above=0.01),
    AlertRule("latency", "warning", "p95", 5, 1, 5, above=1.0),
    AlertRule("score_drift", "warning", "mean_score", 15, 5, 30, above=0.34, below=0.12),
    AlertRule("no_traffic", "warning", "predictions", 15, 5, 15, below=0.0001, no_data_alerts=True),
]


# Upper bounds in seconds of the latency histogram that sliding p95 is read from.
LATENCY_BOUNDS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 2.5, 5.0, 10.0]


def _latency_counts(latency: str, bounds: Sequence[float]) -> list[Feature]:
    return [count_when(f"b{i}", F.col(latency) <= b) for i, b in enumerate(bounds)]


def _from_buckets(q: float, total: Column, bounds: Sequence[float]) -> Column:
    """A quantile from cumulative counts ``b0, b1, ...``: straight lines inside a bucket,
    the last bound beyond it, null without rows."""
    rank = F.lit(float(q)) * total
    value = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(float(bounds[i - 1]) if i else 0.0)
        before = F.col(f"b{i - 1}") if i else F.lit(0)
        width = F.col(f"b{i}") - before
        at = low + (F.lit(float(bounds[i])) - low) * ratio(rank - before, width, 0.0)
        value = F.when(F.col(f"b{i}") >= rank, at).otherwise(value)
    return F.when(total > 0, value)


def sliding_p95(
    log: DataFrame,
    time: str,
    latency: str,
    size: int = 5,
    slide: int = 1,
    bounds: Sequence[float] = tuple(LATENCY_BOUNDS),
    q: float = 0.95,
) -> DataFrame:
    """A latency quantile per sliding window, from histogram counts that panes can add up."""
    counts = _latency_counts(latency, bounds)
    made = sliding(log, time, [*counts, count_of("n", latency)], size, slide)
    return made.select("window_start", _from_buckets(q, F.col("n"), bounds).alias("p95"))


def alert_evaluations(
    log: DataFrame,
    rules: Sequence[AlertRule] = tuple(ALERTS),
    time: str = "predicted_at",
    status: str = "status",
    latency: str = "latency_s",
    score: str = "probability",
) -> DataFrame:
    """The watched value of every rule at each of its evaluations, and whether it breaches.

    The log folds into one-minute panes once and all rules read those. A window
    without rows has no value; each rule says what that means for it.
    """
    features = [
        count_of("n", time),
        count_when("errors", F.col(status) >= 500),
        mean("mean_score", score),
        *_latency_counts(latency, LATENCY_BOUNDS),
    ]
    parts = parts_of(features)
    panes = log.groupBy(pane_start(time, 1).alias("_pane")).agg(
        *[c.alias(n) for p in parts for n, c in p.collect(F.col(time)).items()]
    )
    shapes = sorted({(r.size, r.step) for r in rules})
    covers = F.inline(
        F.array(
            *[
                F.struct(F.lit(z).alias("size"), F.lit(s).alias("step"), F.lit(i).alias("_back"))
                for z, s in shapes
                for i in range(z)
            ]
        )
    )
    start = F.unix_seconds("_pane") - F.col("_back") * 60
    windows = (
        panes.select("*", covers)
        .withColumn("_s", start)
        .where(F.pmod(F.col("_s"), F.col("step") * 60) == 0)
        .groupBy("size", "step", "_s")
        .agg(*[c.alias(n) for p in parts for n, c in p.merge().items()])
        .select("size", "step", "_s", *[f.result.alias(f.name) for f in features])
        .select(
            "size",
            "step",
            F.timestamp_seconds("_s").cast("timestamp_ntz").alias("window_start"),
            F.col("n").cast("double").alias("predictions"),
            ratio(F.col("errors"), F.col("n"), None).alias("error_ratio"),
            "mean_score",
            _from_buckets(0.95, F.col("n"), LATENCY_BOUNDS).alias("p95"),
        )
    )
    lines = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.severity).alias("severity"),
                    F.lit(r.size).alias("size"),
                    F.lit(r.step).alias("step"),
                    F.lit(r.hold).alias("hold"),
                )
                for r in rules
            ]
        )
    )
    minutes = calendar(log, time, 1).select("window_start", lines)
    due = F.pmod(
        F.unix_seconds(F.col("window_start").cast("timestamp")), F.col("step") * 60
    ) == 0
    value, breached = F.lit(None).cast("double"), F.lit(False)
    for r in rules:
        mine = F.col("rule") == r.name
        value = F.when(mine, F.col(r.value)).otherwise(value)
        breached = F.when(mine, r.breached()).otherwise(breached)
    return (
        minutes.where(due)
        .join(windows, ["size", "step", "window_start"], "left")
        .select(
            "rule",
            "severity",
            "step",
            "hold",
            "window_start",
            value.alias("value"),
            breached.alias("breached"),
        )
    )


def alert_rules(evaluations: DataFrame) -> DataFrame:
    """One row per rule: evaluations, breaches, how often it fired and since when first."""
    seen = evaluations.groupBy("rule", "severity", F.col("hold").alias("hold_minutes")).agg(
        F.count(F.lit(1)).alias("evaluations"), count_where(F.col("breached")).alias("breaches")
    )
    fired = (
        sustained(evaluations, "breached", F.col("step"), F.col("hold"), by=["rule"])
        .where("fired")
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("fired"), F.min("started_at").alias("first_started_at"))
    )
    return seen.join(fired, "rule", "left").select(
        "rule",
        "severity",
        "hold_minutes",
        "evaluations",
        "breaches",
        F.coalesce("fired", F.lit(0)).alias("fired"),
        "first_started_at",
    )


def slo_check(
    log: DataFrame,
    time: str,
    status: str,
    latency: str,
    max_p95: float = 1.0,
    max_failures: float = 0.01,
) -> DataFrame:
    """Summary of a load run against its targets, with exact quantiles."""
    found = log.agg(
        F.count(F.lit(1)).alias("requests"),
        count_where(F.col(status) >= 500).alias("failures"),
        F.unix_micros(F.min(time).cast("timestamp")).alias("_a"),
        F.unix_micros(F.max(time).cast("timestamp")).alias("_z"),
    )
    probs = {"median_latency": 0.5, "p95_latency": 0.95}
    exact = only_row(exact_quantiles(log, latency, probs))
    both = found.withColumns({name: exact[name] for name in probs})
    share = ratio(F.col("failures"), F.col("requests"))
    return both.select(
        "requests",
        "failures",
        share.alias("failure_ratio"),
        *probs,
        ratio(F.col("requests"), (F.col("_z") - F.col("_a")) / 1e6, None).alias("throughput"),
        ((share <= max_failures) & (F.col("p95_latency") <= max_p95)).alias("passed"),
    )
