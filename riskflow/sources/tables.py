"""Readers for tables with a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOMES = T.StructType(
    [
        T.StructField("application_id", T.StringType()),
        T.StructField("outcome_at", T.TimestampNTZType()),
        T.StructField("observed_at", T.TimestampNTZType()),
        T.StructField("label", T.IntegerType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("application_id", T.StringType()),
        T.StructField("caller", T.StringType()),
        T.StructField("predicted_at", T.TimestampNTZType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("features", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read with a schema; a path that is not there yet is an empty frame of that schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def jdbc(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    """A relational table. Filters, columns and top-N are pushed to the database.

    Pass partitionColumn, lowerBound, upperBound and numPartitions for a parallel read.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def dispatch(source: str, readers: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Read from the source of that name."""
    if source not in readers:
        raise ValueError(f"unknown source {source!r}; known: {sorted(readers)}")
    return readers[source]()


def store_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Store a table in buckets of its join key. Tables with the same key and number of
    buckets join without a shuffle: decisions and outcomes are joined again and again."""
    (
        df.write.option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .mode("overwrite")
        .saveAsTable(name)
    )


def newest(df: DataFrame, time: str, n: int, tie: str | None = None) -> DataFrame:
    """The most recent n rows: each task keeps n, no global sort."""
    order = [F.col(time).desc(), *([F.col(tie).desc()] if tie else [])]
    return df.orderBy(*order).limit(n)


def keyed(df: DataFrame, key: str = "application_id") -> DataFrame:
    """Decisions that can be joined to an outcome at all."""
    return df.where(F.col(key).isNotNull())


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """Fail if there is not a single row."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df
