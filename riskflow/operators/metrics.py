"""Metrics of a scored table, from one pass over the rows each.

Rows with equal scores fold into one cell before anything is ordered, and ``by``
makes a metric per draw, date, slice or candidate one grouped job, not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import count_where, hash_uniform, only_row, ratio
from riskflow.operators.prefix import exact_quantiles, ordered_prefix, range_bounds
from riskflow.operators.replicates import (
    Prepare,
    block_counts,
    holdout_weights,
    replicate_pr_auc,
    replicate_totals,
    resample_weights,
    whole_blocks,
)

# Smallest distance of a probability from 0 and 1 in the log loss: double epsilon.
EPSILON = 2.220446049250313e-16


def _cells(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None,
    by: Sequence[str],
    bounds: Sequence[float] | None,
) -> DataFrame:
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    y = F.col(label).cast("int")
    sums = {
        "n": F.lit(1).cast("bigint"),
        "tp": F.when(y == 1, w).otherwise(F.lit(0)),
        "fp": F.when(y == 0, w).otherwise(F.lit(0)),
        "ww": w * w,
    }
    return ordered_prefix(df, score, sums, by, descending=True, bounds=bounds)


def ranking(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Average precision, ROC-AUC, Brier score, log loss and row counts per group.

    Average precision is the step sum over distinct scores, not the area under a
    straight-line curve. Where a group has one class only, both ranking metrics are
    null; the Brier score still is defined.
    """
    cells = _cells(df, label, score, weight, by, bounds)
    p = F.col(score).cast("double")
    tp, fp = F.col("tp"), F.col("fp")
    all_tp, all_fp = F.col("all_tp").cast("double"), F.col("all_fp").cast("double")
    both = (all_tp > 0) & (all_fp > 0)
    reached = (F.col("cum_tp") + F.col("cum_fp")).cast("double")
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    mass = F.sum(tp + fp).cast("double")
    found = cells.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum(tp + fp).alias("weight_sum"),
        ratio(F.sum(tp), mass, None).alias("positive_rate"),
        # A cell without weight has nothing to add, and no precision either.
        F.sum(F.when(both & (tp > 0), tp / all_tp * (F.col("cum_tp") / reached))
              .when(both, 0.0)).alias("pr_auc"),
        F.sum(F.when(both, fp / all_fp * ((F.col("cum_tp") - tp / 2.0) / all_tp))).alias("roc_auc"),
        ratio(F.sum(tp * (1 - p) * (1 - p) + fp * p * p), mass, None).alias("brier"),
        ratio(-F.sum(tp * F.log(clipped) + fp * F.log(1 - clipped)), mass, None).alias("log_loss"),
        F.sum("ww").alias("_ww"),
    )
    total = F.col("weight_sum").cast("double")
    return found.withColumn(
        "effective_rows", ratio(total * total, F.col("_ww").cast("double"))
    ).drop("_ww", "weight_sum")


def pr_curve(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Precision and recall at every distinct score used as the cutoff."""
    cells = _cells(df, label, score, None, by, bounds)
    reached = F.col("cum_tp") + F.col("cum_fp")
    return cells.select(
        *by,
        F.col(score).alias("threshold"),
        (F.col("cum_tp") / reached).alias("precision"),
        ratio(F.col("cum_tp"), F.col("all_tp"), None).alias("recall"),
    )


def calibration(
    df: DataFrame,
    label: str,
    score: str,
    bins: int = 10,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Mean score against observed frequency in bins of equal size; empty bins are left out.

    The bin edges are exact quantiles, found in the prefix of the folded scores.
    """
    folded = df.groupBy(score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("tp")
    )
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(folded, score, names, bounds=bounds, counts=F.col("n"))
    edge = only_row(edges)
    placed = folded.withColumn("bin", sum((F.col(score) > edge[e]).cast("int") for e in names))
    return placed.groupBy("bin").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("tp") / F.sum("n")).alias("observed_frequency"),
    )


def confusion(
    df: DataFrame, label: str, score: str, cutoff: float | Column, by: Sequence[str] = ()
) -> DataFrame:
    """The four counts at a cutoff and F1, which is 0 where it has no meaning."""
    hit, true = F.col(score) >= cutoff, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        count_where(~hit & ~true).alias("true_negatives"),
        count_where(hit & ~true).alias("false_positives"),
        count_where(~hit & true).alias("false_negatives"),
        count_where(hit & true).alias("true_positives"),
    )
    tp = F.col("true_positives")
    return counts.withColumn(
        "f1", ratio(2 * tp, 2 * tp + F.col("false_positives") + F.col("false_negatives"))
    )


def selection_probability(prediction: Column, rate: float) -> Column:
    """Chance that an outcome is seen: certain if approved, the holdout rate if declined."""
    if not 0.0 < rate <= 1.0:
        raise ValueError(
            f"holdout rate {rate} is not in (0, 1]; at 0 no weight can stand for the declined"
        )
    return F.when(prediction == 1, F.lit(float(rate))).otherwise(F.lit(1.0))


def with_weights(
    df: DataFrame, rate: float = catalog.HOLDOUT_RATE, prediction: str = "prediction"
) -> DataFrame:
    """Inverse-probability weights."""
    chance = selection_probability(F.col(prediction), rate)
    return df.withColumns({"selection_probability": chance, "weight": F.lit(1.0) / chance})


def effective_rows(df: DataFrame, weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """Kish effective sample size, 0 without weight."""
    w = F.col(weight).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(ratio(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("effective_rows"),
    )


def compare_estimates(
    joined: DataFrame,
    rate: float = catalog.HOLDOUT_RATE,
    truth: DataFrame | None = None,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """``observed``, ``ipw`` and, with an answer key, ``full``, from one grouped job.

    ``observed`` is the approved rows as they are, ``ipw`` all labelled rows with
    inverse-probability weights, ``full`` the whole population.
    """
    columns = ["probability", "label", "prediction"]
    chance = selection_probability(F.col("prediction"), rate)
    kinds = F.array_compact(
        F.array(
            F.when(
                F.col("prediction") == 0,
                F.struct(F.lit("observed").alias("estimate"), F.lit(1.0).alias("weight")),
            ),
            F.struct(F.lit("ipw").alias("estimate"), (F.lit(1.0) / chance).alias("weight")),
        )
    )
    rows = joined.select(*columns, F.inline(kinds))
    if truth is not None:
        whole = truth.select(*columns, F.lit("full").alias("estimate"), F.lit(1.0).alias("weight"))
        rows = rows.unionByName(whole)
    made = ranking(rows, "label", "probability", "weight", ["estimate"], bounds)
    return made.select(
        "estimate", "rows", "effective_rows", "positive_rate", "pr_auc", "roc_auc", "brier"
    )


def bootstrap_std_error(
    df: DataFrame,
    label: str,
    score: str,
    weight: str,
    draws: int = 200,
    seed: int = 0,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Standard error of the weighted average precision by resampling.

    Rows with equal score, label and weight fold into one cell with a count; a draw
    takes exactly as many rows as there are, with replacement, whatever the layout.
    Draws with a single class are skipped. Rows without a score, label or weight take no part.
    """
    cells, drawn, cuts = _resample(df, label, score, weight, seed, bounds)
    per_draw = replicate_pr_auc(cells, score, draws, drawn, cuts)
    return per_draw.agg(
        F.count("pr_auc").alias("draws"), F.stddev_samp("pr_auc").alias("std_error")
    )


def bootstrap_totals(
    df: DataFrame,
    label: str,
    score: str,
    draws: int = 200,
    seed: int = 0,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Rows of either class in each draw: draw, positives, negatives. Their sum is the number of rows."""
    cells, drawn, cuts = _resample(df.withColumn("_one", F.lit(1.0)), label, score, "_one", seed, bounds)
    made = replicate_totals(cells, score, draws, drawn, cuts)
    counts = [F.col(c).cast("bigint").alias(c) for c in ("positives", "negatives")]
    return made.select(F.col("replicate").alias("draw"), *counts)


def _resample(
    df: DataFrame, label: str, score: str, weight: str, seed: int, bounds: Sequence[float] | None
) -> tuple[DataFrame, Prepare, list[float]]:
    """The folded cells, what draws from them, and boundaries that hold whole blocks."""
    number = F.col(score).cast("double")
    given = number.isNotNull() & ~F.isnan(number) & F.col(label).isNotNull() & F.col(weight).isNotNull()
    cells = df.where(given).groupBy(score, label, weight).agg(F.count(F.lit(1)).alias("n"))
    if bounds is None:
        bounds = range_bounds(df, score)
    ones = df.where(given).select(score, F.lit(1).alias("n"))
    drawn = resample_weights(seed, score, label, weight, "n", block_counts(ones, score, "n"))
    return cells, drawn, whole_blocks(bounds)


def usable(
    estimate: DataFrame,
    std_error: DataFrame,
    max_error: float = catalog.UNUSABLE_STD_ERROR,
    min_rows: float = catalog.MIN_EFFECTIVE_ROWS,
) -> DataFrame:
    """Say whether an estimate is precise enough to be quoted. Both frames are one row."""
    error = only_row(std_error)
    both = estimate.withColumns({c: error[c] for c in std_error.columns})
    return both.withColumn(
        "usable",
        F.coalesce(
            (F.col("std_error") <= max_error) & (F.col("effective_rows") >= min_rows),
            F.lit(False),
        ),
    )


def holdout_sweep(
    truth: DataFrame,
    key: str,
    rates: Sequence[float] = tuple(catalog.HOLDOUT_RATES),
    draws: int = catalog.HOLDOUT_DRAWS,
    cost_fn: float = catalog.COST_FALSE_NEGATIVE,
    cost_fp: float = catalog.COST_FALSE_POSITIVE,
    seed: int = catalog.SEED,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """What a holdout of each rate buys and costs, over repeated draws.

    Rates are nested: a declined row drawn at 1 % is drawn at 5 % too. So a row is
    drawn once per repeat and kept with the smallest rate that takes it. Approved
    rows are the same in all draws and are folded once.
    """
    rates = sorted(rates)
    if bounds is None:
        bounds = range_bounds(truth, "probability")
    def drawn(number: Column) -> Column:
        u = hash_uniform(F.concat_ws(":", number.cast("string"), F.col(key)), seed)
        return F.struct(number.alias("draw"), u.alias("_u"))

    # Draws that take a row are picked before a row is made for each.
    numbers = F.transform(F.sequence(F.lit(1), F.lit(draws)), drawn)
    taking = F.filter(numbers, lambda d: d["_u"] < rates[-1])
    declined = (
        truth.where("prediction = 1")
        .select("probability", "label", F.inline(taking))
        .withColumn("first", sum((F.col("_u") >= r).cast("int") for r in rates))
        .groupBy((F.col("draw") - 1).alias("draw"), "first", "probability", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    approved = (
        truth.where("prediction = 0")
        .groupBy("probability", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(-1).alias("draw"), F.lit(0).alias("first"), "probability", "label", "n")
    )
    weights = holdout_weights(rates, draws, "probability")
    aucs = replicate_pr_auc(
        declined.unionByName(approved), "probability", len(rates) * draws, weights, bounds
    ).select(
        F.floor(F.col("replicate") / draws).cast("int").alias("slot"),
        (F.col("replicate") % draws).alias("draw"),
        "pr_auc",
    )
    # Counts per draw and smallest rate, then added up over the rates above it.
    taken = declined.groupBy("draw", "first").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad")
    )
    slots = F.explode(F.sequence(F.col("first"), F.lit(len(rates) - 1))).alias("slot")
    extras = taken.select("*", slots).groupBy("slot", "draw").agg(
        F.sum("n").alias("extra"), F.sum("bad").alias("bad")
    )
    population = truth.agg(F.count(F.lit(1))).scalar()
    true_auc = ranking(truth, "label", "probability", bounds=bounds).select("pr_auc").scalar()
    extra, bad = F.coalesce("extra", F.lit(0)), F.coalesce("bad", F.lit(0))
    cost = F.lit(float(cost_fn)) * bad - F.lit(float(cost_fp)) * (extra - bad)
    rate = F.element_at(F.array(*[F.lit(r) for r in rates]), F.col("slot") + 1)
    return (
        aucs.join(extras, ["slot", "draw"], "left")  # a draw may take nobody
        .withColumns({"_all": population, "_true": true_auc})
        .groupBy(rate.alias("holdout_rate"))
        .agg(
            F.count(F.lit(1)).alias("draws"),
            F.avg(extra).alias("mean_extra_approvals"),
            F.avg("pr_auc").alias("mean_pr_auc_ipw"),
            F.stddev_samp("pr_auc").alias("std_across_draws"),
            (F.avg("pr_auc") - F.max("_true")).alias("mean_error_vs_truth"),
            F.avg(cost / F.col("_all") * 1000).alias("cost_per_1000"),
        )
    )
