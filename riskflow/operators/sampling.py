"""Seeded splits, folds and holdouts that any task can repeat."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import hash_uniform
from riskflow.operators.prefix import row_positions


def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str,
    shares: Mapping[str, float],
    rest: str,
    seed: int = catalog.SEED,
    name: str = "cohort",
) -> DataFrame:
    """Exact shares of every stratum, taken one after the other from what is left.

    ``{"current": 0.25, "test": 0.2}`` with ``rest="train"`` gives a quarter to
    ``current``, a fifth of the remainder to ``test`` and the others to ``train``.
    ``key`` must be unique.
    """
    placed = row_positions(df, [stratum], hash_uniform(key, seed), [key], "_pos", "_size")
    label: Column | None = None
    taken: Column = F.lit(0).cast("bigint")
    for cohort, share in shares.items():
        taken = taken + F.round(F.lit(float(share)) * (F.col("_size") - taken)).cast("bigint")
        hit = F.col("_pos") <= taken
        label = F.when(hit, cohort) if label is None else label.when(hit, cohort)
    return placed.withColumn(name, label.otherwise(rest)).drop("_pos", "_size")


def loose_split(
    df: DataFrame,
    key: str,
    shares: Mapping[str, float],
    rest: str,
    seed: int = catalog.SEED,
    name: str = "cohort",
) -> DataFrame:
    """The same nesting by hash alone: shares hold in expectation, and nothing shuffles."""
    u = hash_uniform(key, seed)
    label: Column | None = None
    edge, left = 0.0, 1.0
    for cohort, share in shares.items():
        edge, left = edge + share * left, left * (1 - share)
        label = F.when(u < edge, cohort) if label is None else label.when(u < edge, cohort)
    return df.withColumn(name, label.otherwise(rest))


def kfold(
    df: DataFrame, key: str, stratum: str, k: int, seed: int = catalog.SEED, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1, dealt round inside each stratum."""
    placed = row_positions(df, [stratum], hash_uniform(key, seed), [key], "_pos", "_size")
    return placed.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos", "_size")


def observe(
    df: DataFrame,
    key: str,
    prediction: str = "prediction",
    rate: float = catalog.HOLDOUT_RATE,
    seed: int = catalog.SEED,
) -> DataFrame:
    """Who generates an outcome: all approved rows, and a random share of the declined."""
    declined = F.col(prediction) == 1
    drawn = declined & (hash_uniform(key, seed) < F.lit(float(rate)))
    return df.withColumns({"observable": ~declined | drawn, "holdout": drawn})
