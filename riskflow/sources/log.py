"""The prediction log: append-only files, one folder per day of the decision."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.reshape import flatten, strip_prefix


def with_date(df: DataFrame, time: str = "predicted_at") -> DataFrame:
    """Partition by the day of the decision, not of the write: a replay lands in place."""
    return df.withColumn("date", F.to_date(time))


def append_log(df: DataFrame, path: str, time: str = "predicted_at") -> None:
    """Append a batch, nested features flattened to ``features.<name>`` columns.

    No shuffle: each task writes its rows, so a day with a third of the log is
    written by many tasks. ``compact_log`` merges small files later.
    """
    flat = with_date(flatten(df), time)
    flat.write.partitionBy("date").mode("append").parquet(path)


def compact_log(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite many small files as few per day, at another path.

    Rebalancing gathers a quiet day in one file and splits a busy one over many tasks.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(path).hint("rebalance", "date")
    rows.write.partitionBy("date").mode("overwrite").parquet(target)


def read_log(
    spark: SparkSession,
    path: str,
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> DataFrame:
    """The log of some days, with features under their own names. Other days are not listed."""
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("date") <= F.lit(until))
    return strip_prefix(rows)


def retained(df: DataFrame, today: dt.date, days: int = 30, date: str = "date") -> DataFrame:
    """Rows young enough to keep. On a partitioned log the old days are not read."""
    return df.where(F.col(date) >= F.lit(today - dt.timedelta(days=days)))


def merged_schema(*frames: DataFrame) -> DataFrame:
    """Union of frames whose later versions added columns."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def write_jdbc(df: DataFrame, url: str, dbtable: str, **options: str) -> None:
    """Row inserts into a relational table, in parallel from the executors."""
    df.write.format("jdbc").options(url=url, dbtable=dbtable, **options).mode("append").save()


def discard(df: DataFrame) -> None:
    """Run the plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


Sink = Callable[[DataFrame], None]


def build_sink(kind: str, best_effort: bool = False, **options: str) -> Sink:
    """A sink by name: ``files``, ``jdbc`` or ``none``.

    ``best_effort`` logs a failed write instead of failing the scoring. It is off
    unless asked for, because a lost write is silent and defeats exactly-once.
    """
    sinks: dict[str, Sink] = {
        "files": lambda df: append_log(df, options["path"]),
        "jdbc": lambda df: write_jdbc(df, **options),
        "none": discard,
    }
    if kind not in sinks:
        raise ValueError(f"unknown sink {kind!r}; known: {sorted(sinks)}")
    if kind == "files" and not options.get("path"):
        raise ValueError("a file sink needs a path")
    write = sinks[kind]
    return tolerant(write) if best_effort else write


def tolerant(write: Sink) -> Sink:
    """The same sink, with failures logged."""
    import logging

    def attempt(df: DataFrame) -> None:
        try:
            write(df)
        except Exception:
            logging.getLogger(__name__).exception("the log was not written")

    return attempt
