"""From scores to decisions: cutoffs by cost, the quality gate, the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import count_where, ratio


def expected_cost(
    df: DataFrame,
    label: str,
    score: str,
    cutoff: float | Column,
    cost_fn: float = catalog.COST_FALSE_NEGATIVE,
    cost_fp: float = catalog.COST_FALSE_POSITIVE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean cost per row at one cutoff."""
    hit, true = F.col(score) >= cutoff, F.col(label) == 1
    missed = count_where(~hit & true) * F.lit(float(cost_fn))
    wrong = count_where(hit & ~true) * F.lit(float(cost_fp))
    return df.groupBy(*by).agg(ratio(missed + wrong, F.count(F.lit(1)), None).alias("expected_cost"))


def threshold_curve(
    df: DataFrame,
    label: str,
    score: str,
    cost_fn: float = catalog.COST_FALSE_NEGATIVE,
    cost_fp: float = catalog.COST_FALSE_POSITIVE,
    grid: Sequence[float] = tuple(catalog.CUTOFFS),
    by: Sequence[str] = (),
) -> DataFrame:
    """Cost and decline rate at every cutoff of the grid, from one pass over the rows.

    A row falls between two cutoffs; only the counts per gap meet the grid.
    """
    cuts = sorted(grid)
    gaps = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_score", outputCol="_gap"
    )
    placed = gaps.transform(df.withColumn("_score", F.col(score).cast("double")))
    folded = placed.groupBy(*by, "_gap").agg(
        count_where(F.col(label) == 1).alias("_pos"), count_where(F.col(label) == 0).alias("_neg")
    )
    asked = F.inline(
        F.array(
            *[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)]
        )
    )
    above = F.col("_gap") > F.col("_i")
    pos, neg = F.col("_pos"), F.col("_neg")
    return (
        folded.select("*", asked)
        .groupBy(*by, "threshold")
        .agg(
            F.sum(F.when(~above, pos).otherwise(0)).alias("_fn"),
            F.sum(F.when(above, neg).otherwise(0)).alias("_fp"),
            F.sum(F.when(above, pos + neg).otherwise(0)).alias("_declined"),
            F.sum(pos + neg).alias("_n"),
        )
        .select(
            *by,
            "threshold",
            (
                (F.lit(float(cost_fn)) * F.col("_fn") + F.lit(float(cost_fp)) * F.col("_fp"))
                / F.col("_n")
            ).alias("cost"),
            (F.col("_declined") / F.col("_n")).alias("decline_rate"),
        )
    )


def threshold_choice(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cheapest cutoff, the lowest one among equals, and the cost at one half."""
    order = F.struct("cost", "threshold")
    best = curve.groupBy(*by).agg(
        F.min_by(F.struct("threshold", "cost", "decline_rate"), order).alias("_best"),
        F.max(F.when(F.col("threshold") == catalog.DEFAULT_CUTOFF, F.col("cost"))).alias(
            "cost_at_half"
        ),
    )
    return best.select(
        *by,
        F.col("_best.threshold").alias("threshold"),
        F.col("_best.cost").alias("expected_cost"),
        "cost_at_half",
        (F.col("cost_at_half") - F.col("_best.cost")).alias("cost_reduction"),
        F.col("_best.decline_rate").alias("decline_rate"),
    )


def quality_gate(
    metrics: DataFrame,
    alias: str = "alias",
    value: str = "pr_auc",
    floor: float = catalog.MIN_PR_AUC,
    tolerance: float = catalog.MAX_REGRESSION,
) -> DataFrame:
    """Verdict on the challenger, with every reason against it. No challenger, no pass."""
    pair = metrics.agg(
        F.max(F.when(F.col(alias) == "challenger", F.col(value))).alias("challenger"),
        F.max(F.when(F.col(alias) == "champion", F.col(value))).alias("champion"),
        count_where(F.col(alias) == "challenger").alias("_found"),
    )
    missing = F.col("_found") == 0
    reasons = F.array_compact(
        F.array(
            F.when(missing, F.lit("no challenger")),
            F.when(F.col("challenger") < floor, F.lit("below the floor")),
            F.when(
                F.col("challenger") - F.col("champion") < -tolerance,
                F.lit("worse than the champion"),
            ),
        )
    )
    judged = pair.withColumn("reasons", reasons)
    return judged.select(
        "challenger", "champion", (F.size("reasons") == 0).alias("passed"), "reasons"
    )


def best_candidate(metrics: DataFrame, name: str = "candidate", value: str = "pr_auc") -> DataFrame:
    """The candidate with the highest value; the first by name among equals."""
    top = metrics.agg(F.max(value)).scalar()
    return metrics.where(F.col(value) == top).agg(
        F.min(name).alias(name), F.max(value).alias(value)
    )


def newest_version(versions: DataFrame, model: str = "model", version: str = "version") -> DataFrame:
    return versions.groupBy(model).agg(F.max(version).alias(version))


def promote(
    aliases: DataFrame,
    versions: DataFrame,
    gate: DataFrame,
    force: bool = False,
    model: str = "model",
) -> DataFrame:
    """The alias table after a promotion.

    ``challenger`` follows the newest version; ``champion`` takes the challenger's
    version if the gate passed or the promotion is forced, and stays otherwise.
    """
    fresh = newest_version(versions, model).select(model, F.col("version").alias("_new"))
    now = aliases.groupBy(model).agg(
        F.max(F.when(F.col("alias") == "champion", F.col("version"))).alias("_champion")
    )
    allowed = gate.select(F.col("passed") | F.lit(force)).scalar()
    after = fresh.join(now, model, "left").withColumn(
        "_champion", F.when(allowed, F.col("_new")).otherwise(F.col("_champion"))
    )
    rows = F.array(
        F.struct(F.lit("challenger").alias("alias"), F.col("_new").alias("version")),
        F.struct(F.lit("champion").alias("alias"), F.col("_champion").alias("version")),
    )
    return after.select(model, F.inline(rows)).where("version is not null")
