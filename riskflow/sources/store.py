"""The outcome store: append-only files, first report wins, readable as of a date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from riskflow.operators import labels
from riskflow.sources.tables import OUTCOMES, declared

COLUMNS = OUTCOMES.fieldNames()
KEY, BUCKET = "application_id", "key_bucket"


class OutcomeStore:
    """Outcomes under a path, in folders by a hash of the key. Recording the same feed again adds nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _rows(self) -> DataFrame:
        return declared(self.spark, self.path, StructType([*OUTCOMES.fields, StructField(BUCKET, IntegerType())]))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(self.buckets)).cast("int"))

    def read(self, as_of: dt.datetime | str | None = None) -> DataFrame:
        """What was known at ``as_of``; a typed empty frame before the first write."""
        return labels.known_by(self._rows().select(*COLUMNS), as_of)

    def touched(self, feed: DataFrame) -> DataFrame:
        """Stored rows of the folders that the feed's keys fall into, and of no others."""
        found = self._bucketed(feed.select(KEY)).select(BUCKET).distinct().collect()
        return self._rows().filter(F.col(BUCKET).isin([r[BUCKET] for r in found])).select(*COLUMNS)

    def record(self, feed: DataFrame) -> int:
        """Append the outcomes of keys that are not stored yet; how many those were.

        A small batch meets only the folders of its keys. A run that died while appending
        is repeated safely: what it stored counts as known. One writer at a time; a
        lakehouse table would MERGE instead.
        """
        near = self.touched(feed)
        before = near.count()
        fresh = self._bucketed(labels.insert_if_absent(near, feed.select(*COLUMNS)).select(*COLUMNS))
        fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        return self.touched(feed).count() - before


class NullStore:
    """Keeps nothing, for runs without a label pipeline."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, as_of: dt.datetime | str | None = None) -> DataFrame:
        return self.spark.createDataFrame([], OUTCOMES)

    def record(self, feed: DataFrame) -> int:
        return 0


def build_store(spark: SparkSession, kind: str, path: str = "") -> OutcomeStore | NullStore:
    """A store by name: ``files`` or ``none``."""
    if kind == "files":
        if not path:
            raise ValueError("a file store needs a path")
        return OutcomeStore(spark, path)
    if kind == "none":
        return NullStore(spark)
    raise ValueError(f"unknown outcome store {kind!r}")
