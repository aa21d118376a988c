"""Streaming operators: scoring, windows, late labels, sessions and alert state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow.functions.scalar import count_where
from riskflow.operators.contract import Contract, decide
from riskflow.operators.sketches import RANK_ENTRIES, quantile_parts
from riskflow.session import shared_folder
from riskflow.sources.store import OutcomeStore
from riskflow.streaming.runs import event_time, finish

Scorer = Callable[[DataFrame], DataFrame]


def score_stream(
    stream: DataFrame, contract: Contract, scorer: Scorer, score: str, cutoff: float, version: str
) -> DataFrame:
    """Check, score, decide: every row comes out once, accepted with a decision or
    rejected with its reasons. Rejected rows carry no score."""
    judged = contract.judged(stream).withColumn("accepted", F.size("reasons") == 0)
    scored = decide(scorer(judged), score, cutoff)
    ok = F.col("accepted")
    return scored.withColumns(
        {
            score: F.when(ok, F.col(score)),
            "prediction": F.when(ok, F.col("prediction")),
            "model_version": F.lit(version),
        }
    )


def log_scored(scored: DataFrame, path: str, checkpoint: str) -> None:
    """Log and quarantine in one write per batch, apart by the ``accepted`` folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/b={number}")

    finish(scored, write, checkpoint)


def windows(
    stream: DataFrame,
    time: str,
    size: str,
    aggregates: Sequence[Column],
    slide: str | None = None,
    by: Sequence[str] = (),
    delay: str = "1 hour",
) -> DataFrame:
    """Aggregates per event-time window. State is dropped once the watermark passes.

    In append mode a window appears when it is closed, in update mode at every change.
    """
    slot = F.window(time, size, slide) if slide else F.window(time, size)
    made = event_time(stream, time, delay).groupBy(slot.alias("_w"), *by).agg(*aggregates)
    rest = [c for c in made.columns if c not in ("_w", *by)]
    return made.select(*by, F.col("_w.start").alias("window_start"), *rest)


def request_windows(stream: DataFrame, time: str, status: str, size: str = "1 day") -> DataFrame:
    """Requests and failures per window."""
    return windows(
        stream,
        time,
        size,
        [F.count(F.lit(1)).alias("requests"), count_where(F.col(status) >= 500).alias("errors")],
    )


def quantile_panes(
    stream: DataFrame, time: str, value: str, pane: int = 60, entries: int = RANK_ENTRIES, delay: str = "1 hour"
) -> DataFrame:
    """A quantile sketch per pane of minutes: the state of a pane is one sketch, however busy.

    Closed panes go out once; ``sketches.merged_quantiles`` makes windows of them.
    """
    return windows(stream, time, f"{int(pane)} minutes", quantile_parts(value, entries), delay=delay)


def sessions(
    stream: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Bursts of activity per caller that a pause of ``gap`` ends.

    Rows of a session merge inside a task before they shuffle if
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on.
    """
    made = (
        event_time(stream, time, delay)
        .groupBy(F.session_window(time, gap).alias("_w"), by)
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return made.select(
        by,
        F.col("_w.start").alias("session_start"),
        F.col("_w.end").alias("session_end"),
        "requests",
    )


def silences(
    stream: DataFrame, time: str, by: str, minutes: int = 15, delay: str = "1 hour"
) -> DataFrame:
    """When a caller fell silent: the end of a session whose gap is the tolerated pause.

    A row appears once the watermark has passed that end without traffic.
    """
    made = sessions(stream, time, by, f"{int(minutes)} minutes", delay)
    return made.select(by, F.col("session_end").alias("silent_since"), "requests")


def ingest_outcomes(feed: DataFrame, store: OutcomeStore, checkpoint: str) -> None:
    """Bring a feed of outcomes into the store; replays and restatements change nothing.

    The store holds the keys, so the stream keeps no state however late a label is.
    """
    finish(feed, lambda batch, number: store.record(batch) and None, checkpoint)


def distinct_feed(feed: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the delay, with bounded state."""
    return event_time(feed, time, delay).dropDuplicatesWithinWatermark([key])


def label_stream(
    decisions: DataFrame,
    outcomes: DataFrame,
    key: str = "application_id",
    window_days: int = 30,
    horizon_days: int = 150,
    delay: str = "1 day",
    how: str = "inner",
) -> DataFrame:
    """Decisions joined to outcomes that report after the window closed, up to a horizon.

    The horizon bounds the state: a decision is kept that long and no longer. Labels
    beyond it are found by the batch join on the stored tables.
    """
    left = event_time(decisions, "predicted_at", delay)
    right = event_time(outcomes, "observed_at", delay).withColumnRenamed(key, "_key")
    start = F.col("predicted_at") + F.expr(f"INTERVAL {int(window_days)} DAY")
    end = F.col("predicted_at") + F.expr(f"INTERVAL {int(horizon_days)} DAY")
    due = (F.col("observed_at") >= start) & (F.col("observed_at") <= end)
    return left.join(right, (F.col(key) == F.col("_key")) & due, how).drop("_key")


ALERT_OUTPUT = "{keys}, at timestamp, state string"
ALERT_STATE = "since bigint, firing boolean, last bigint, timer bigint"
SILENCE_STATE = "last bigint, silent boolean, timer bigint"

#: What timers and state with a value per key need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Timed(StatefulProcessor):
    """A value per key, one timer that is moved as rows come, and rows in order of time.

    What a key gets per batch is one row per evaluation or pane, so it is bounded by the
    clock and not by the log; of each only the time and two numbers are held.
    """

    def __init__(self, keys: Sequence[str], state: str):
        self.keys, self.state = list(keys), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def close(self) -> None:
        pass

    def arrange(self, old: int | None, new: int | None) -> None:
        """Move the key's timer; both are seconds."""
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old * 1000)
        if new is not None:
            self.handle.registerTimer(new * 1000)

    def told(self, key: tuple, changes: list[tuple[int, str]], unit: str) -> Iterator[pd.DataFrame]:
        if changes:
            made = pd.DataFrame({k: [v] * len(changes) for k, v in zip(self.keys, key, strict=True)})
            made["at"] = pd.to_datetime([at for at, _ in changes], unit=unit)
            made["state"] = [state for _, state in changes]
            yield made


class _Alerts(_Timed):
    """Firing after ``hold`` minutes of breaches, resolved without one, no data without evaluations."""

    def __init__(self, keys: Sequence[str], patience: int):
        super().__init__(keys, ALERT_STATE)
        self.patience = patience * 60

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [np.column_stack([r["at"], r["breached"], r["hold"] * 60]).astype(np.int64) for r in rows]
        table = np.concatenate(parts)
        since, firing, last, timer = self.value.get() if self.value.exists() else (None, False, None, None)
        changes = []
        for at, breached, hold in table[np.argsort(table[:, 0], kind="stable")].tolist():
            if last is not None and at - last > self.patience:
                changes.append((last + self.patience, "no_data"))
                since, firing = None, False
            last = at if last is None else max(at, last)
            if not breached:
                if firing:
                    changes.append((at, "resolved"))
                since, firing = None, False
                continue
            since = at if since is None else since
            if not firing and at - since >= hold:
                firing = True
                changes.append((at, "firing"))
        due = last + self.patience
        self.arrange(timer, due)
        self.value.update((since, bool(firing), last, due))
        yield from self.told(key, changes, "s")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, firing, last, timer = self.value.get()
        if last is not None and timer is not None and expiredTimerInfo.getExpiryTimeInMs() == timer * 1000:
            self.value.clear()
            yield from self.told(key, [(timer, "no_data")], "s")


class _Silences(_Timed):
    """Silent once the watermark has passed the tolerated pause, back with the next row."""

    def __init__(self, keys: Sequence[str], minutes: int):
        super().__init__(keys, SILENCE_STATE)
        self.pause = minutes * 60_000_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = np.concatenate([r[["first", "last"]].to_numpy(np.int64) for r in rows])
        last, silent, timer = self.value.get() if self.value.exists() else (None, False, None)
        changes = []
        for first, end in table[np.lexsort((table[:, 1], table[:, 0]))].tolist():
            if last is not None and (silent or first - last > self.pause):
                if not silent:
                    changes.append((last + self.pause, "silent"))
                changes.append((first, "back"))
            last, silent = end if last is None else max(last, end), False
        # Timers are kept in whole seconds, rounded up: never before the pause is over.
        due = -(-(last + self.pause) // 1_000_000)
        self.arrange(timer, due)
        self.value.update((last, False, due))
        yield from self.told(key, changes, "us")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent, timer = self.value.get()
        if not silent and timer is not None and expiredTimerInfo.getExpiryTimeInMs() == timer * 1000:
            self.value.update((last, True, None))
            yield from self.told(key, [(last + self.pause, "silent")], "us")


def _with_timers(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    output = ALERT_OUTPUT.format(keys=", ".join(f"`{k}` {types[k]}" for k in keys))
    return stream.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "eventTime")


def alert_states(
    evaluations: DataFrame, by: Sequence[str] = ("rule",), patience: int = 60, delay: str = "1 hour"
) -> DataFrame:
    """Changes of each alert: it fires once its condition has held for ``hold`` minutes,
    is resolved by the first evaluation without a breach, and goes to ``no_data`` when
    none has come for ``patience`` minutes, by the watermark if nothing follows. A null
    condition is no breach.

    Takes evaluations, one row per key and step, never log rows. Keys may be a rule and a
    caller: the more keys, the more tasks. After ``no_data`` a key holds no state.
    """
    rows = event_time(evaluations, "window_start", delay).select(
        *by,
        "window_start",
        F.unix_seconds("window_start").alias("at"),
        F.coalesce(F.col("breached").cast("bigint"), F.lit(0)).alias("breached"),
        F.coalesce(F.col("hold").cast("bigint"), F.lit(0)).alias("hold"),
    )
    return _with_timers(rows, by, _Alerts(by, patience))


def silence_states(
    stream: DataFrame, time: str, by: Sequence[str], minutes: int = 15, delay: str = "1 hour"
) -> DataFrame:
    """When each caller fell silent and when it came back: ``minutes`` without a row.

    Rows fold into panes of a minute before any state is kept per caller, so a caller
    with a third of all rows brings one row a minute. The end of a silence that nothing
    follows is told by a timer.
    """
    first, last = F.min(time), F.max(time)
    made = event_time(stream, time, delay).groupBy(F.window(time, "1 minute").alias("_w"), *by)
    made = made.agg(F.unix_micros(first).alias("first"), F.unix_micros(last).alias("last"))
    panes = made.select(*by, F.window_time("_w").alias("_t"), "first", "last")
    return _with_timers(panes, by, _Silences(by, minutes))


def with_end(stream: DataFrame, *times: str, at: str = "2200-01-01", key: str | None = None) -> DataFrame:
    """The stream and, as its last row, a moment far ahead that moves the watermark on.

    For a feed that is read to its end: windows, sessions and outer joins close, and timers
    run out. The row has nulls elsewhere, so it joins nothing; what it opens itself stays
    open and is never told. It must come with or after the last rows, as it does
    when all that is available is read as one batch.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    marks = {t: at for t in times} | ({key: "\uffff end"} if key else {})
    row = [F.lit(marks.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*row).coalesce(1).write.parquet(root)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(root))
