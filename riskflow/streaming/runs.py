"""Reading tables as streams and running streams into tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import shared_folder
from riskflow.sources.tables import table


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table as a stream, whether it is one file or a folder of files."""
    stored = table(spark, folder, name)
    reader = spark.readStream.schema(stored.schema)
    # One row tells; listing the files would bring all their names to the driver.
    first = stored.select(F.col("_metadata.file_path").alias("path")).first()
    if first and first["path"].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def event_time(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks want a timestamp with time zone; the tables keep wall-clock times."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def wall_clock(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


def finish(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process everything that is available, batch by batch, and stop."""
    running = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    running.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Store each batch in a folder of its own, which a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/b={number}")

    return write


def appended(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run an append stream to the end and return its rows as a table."""
    spark = stream.sparkSession
    root = shared_folder(spark)
    finish(stream, batch_writer(f"{root}/rows"), f"{root}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows").select(*stream.columns)


def updated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an update stream to the end and return the last state of every key.

    Batches are stored as they come; the newest one that mentions a key counts.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    finish(stream, batch_writer(f"{root}/rows"), f"{root}/checkpoint", "update")
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{root}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("b")).alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)
