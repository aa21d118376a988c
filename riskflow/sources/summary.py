"""Small results as JSON, for people and tools outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_summary(summary: DataFrame, path: str, most: int = 10_000) -> None:
    """Write a summary frame as one JSON file in a folder, one object per row.

    Meant for one row per metric, group or column. A frame of more than ``most`` rows is
    refused, because one task writes it.
    """
    if summary.limit(most + 1).count() > most:
        raise ValueError(f"a summary has at most {most} rows; write a table instead")
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_summary(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
