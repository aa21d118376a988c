from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from riskflow import catalog  # noqa: E402
from riskflow.functions.scalar import hash_uniform  # noqa: E402
from riskflow.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


def whole(key, seed, low, high):
    """A whole number in [low, high] from the hash of a key."""
    return (F.lit(low) + F.floor(hash_uniform(key, seed) * (high - low + 1))).cast("int")


@pytest.fixture(scope="session")
def applications(spark):
    """400 valid records whose target follows the newest status."""
    ranges = {
        "limit_bal": (10_000, 799_999),
        "sex": (1, 2),
        "education": (1, 4),
        "marriage": (1, 3),
        "age": (21, 78),
        **{p[1]: (-2, 8) for p in catalog.PERIODS},
        **{f"bill_amt{i}": (-50_000, 499_999) for i in range(1, 7)},
        **{f"pay_amt{i}": (0, 99_999) for i in range(1, 7)},
    }
    df = spark.range(400).withColumnRenamed("id", "customer_id")
    df = df.withColumns(
        {c: whole("customer_id", i, lo, hi) for i, (c, (lo, hi)) in enumerate(ranges.items())}
    )
    chance = 1 / (1 + F.exp(-(F.col("pay_0") - 1)))
    hit = (hash_uniform("customer_id", 99) < chance).cast("int")
    return df.withColumn(catalog.TARGET, hit).cache()


@pytest.fixture(scope="session")
def calibrated(spark):
    """20,000 scores that are their own probability."""
    df = spark.range(20_000).withColumn("p", hash_uniform("id", 1))
    return df.withColumn("y", (hash_uniform("id", 2) < F.col("p")).cast("int")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
