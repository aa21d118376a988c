"""What several of these operators share: stored tables, word counts, small joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.session import shared_folder

#: Runs of anything but the six ASCII blanks. Fixed by the data contract.
WORD = r"[^\x20\x09-\x0D]+"

#: A frame of at most this many rows of a few plain columns may be broadcast.
BROADCAST_ROWS = 100_000

#: Whole texts that a Python worker gets at a time where each is worked on by itself.
TEXTS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder and read back.

    Cuts lineage and gives later joins a known size. The files survive executors;
    whoever owns ``spark.checkpoint.dir`` removes them.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXTS) -> Iterator[None]:
    """Jobs run meanwhile hand at most ``rows`` rows at a time to Python.

    A batch is held by the executor, by its worker and there once more as strings, so ten
    thousand texts, the default, take many times what the work on one of them does.
    """
    before = spark.conf.get(_BATCH, None)
    held = int(before or 0)
    spark.conf.set(_BATCH, str(min(rows, held) if held > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(as_column(text), F.lit(WORD)), F.lit(0)).cast("long")


def attach(rows: DataFrame, few: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key; null is a key like any other.

    Broadcasts ``few`` after counting it. A larger one is joined by a shuffle, where
    adaptive execution splits a key that holds many of the rows; salting would copy
    every key of what may be as large as the rows themselves. ``few`` should be
    stored, because it is counted first.
    """
    (other,) = fresh(rows, "_key")
    few = few.withColumnRenamed(key, other)
    side = F.broadcast(few) if few.limit(limit + 1).count() <= limit else few.hint("merge")
    return rows.join(side, rows[key].eqNullSafe(few[other]), "left").drop(other)


def labelled_sample(labels: DataFrame, column: str, held_out: Column, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled documents as (doc_id, label, draw), those with the smallest draws.

    The draw is a hash of the id, so the sample is the same for any layout. Rows without an
    id or a label and held-out rows take no part; an id with several labels has the largest.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out)
    one = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    drawn = one.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1))
    return stored(drawn.orderBy("draw", "doc_id").limit(rows))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label, draw): one text, the smallest, per sampled document. The sample's bound lets it be broadcast."""
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = joined.groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text"))
    return texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label", "draw")


def held_out(modulus: int, rest: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false without an id."""
    code = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(code % modulus == rest, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of the frame's columns."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
