"""Session defaults and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # No call-site lookup per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="riskflow-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine: on a
    cluster the executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    """How many ranges an ordered scan is cut into: one per shuffle partition."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
