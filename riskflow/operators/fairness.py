"""Group rates and the gaps between groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import band, count_where, ratio

RATES = ["selection_rate", "true_positive_rate", "false_positive_rate", "base_rate"]


def _rates(label: str, prediction: str) -> list:
    true, chosen = F.col(label) == 1, F.col(prediction) == 1
    rows = F.count(F.lit(1))
    n_pos = count_where(true)
    return [
        rows.alias("n"),
        n_pos.alias("n_pos"),
        ratio(count_where(chosen), rows).alias("selection_rate"),
        # 0 for a group without positives (or negatives): n_pos tells which those are.
        ratio(count_where(chosen & true), n_pos).alias("true_positive_rate"),
        ratio(count_where(chosen & ~true), rows - n_pos).alias("false_positive_rate"),
        ratio(n_pos, rows).alias("base_rate"),
    ]


def group_rates(df: DataFrame, attribute: str, label: str, prediction: str) -> DataFrame:
    """Rates of the groups of one attribute; rows without a group are left out."""
    rows = df.where(F.col(attribute).isNotNull())
    return rows.groupBy(F.col(attribute).cast("string").alias("group")).agg(
        *_rates(label, prediction)
    )


def audit(
    df: DataFrame,
    label: str,
    prediction: str,
    attributes: Sequence[str],
    bands: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """Rates for the groups of every attribute, from one pass with grouping sets.

    Attributes that the frame lacks are skipped. ``bands`` cuts a number into
    intervals first; values outside all of them belong to no group.
    """
    present = [a for a in attributes if a in df.columns]
    bands = bands or {}
    groups = [
        (band(a, bands[a]) if a in bands else F.col(a)).cast("string").alias(f"_g_{a}")
        for a in present
    ]
    keys = [f"_g_{a}" for a in present]
    rows = df.select(
        F.col(label).alias("_label"), F.col(prediction).alias("_prediction"), *groups
    )
    sets = [[F.col(k)] for k in keys]
    made = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_set"), *_rates("_label", "_prediction")
    )
    # grouping_id has a 0 bit for the column that a row is grouped by.
    full = 2 ** len(keys) - 1
    name, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (a, k) in enumerate(zip(present, keys, strict=True)):
        own = F.col("_set") == F.lit(full - 2 ** (len(keys) - 1 - i))
        name = F.when(own, F.lit(a)).otherwise(name)
        group = F.when(own, F.col(k)).otherwise(group)
    return made.select(
        name.alias("attribute"), group.alias("group"), "n", "n_pos", *RATES
    ).where(F.col("group").isNotNull())


def gaps(
    audited: DataFrame, limit: float = catalog.MAX_SELECTION_GAP, exclude_empty: bool = False
) -> DataFrame:
    """Highest minus lowest rate over the groups of an attribute; 0 for a single group.

    ``exclude_empty`` leaves groups without positives out of the opportunity gap,
    where their rate of 0 says nothing.
    """

    def gap(rate: str):
        value = F.col(rate)
        if exclude_empty and rate == "true_positive_rate":
            value = F.when(F.col("n_pos") > 0, value)
        return F.when(F.count(value) > 1, F.max(value) - F.min(value)).otherwise(F.lit(0.0))

    found = audited.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("groups"),
        gap("selection_rate").alias("selection_rate_gap"),
        gap("true_positive_rate").alias("equal_opportunity_gap"),
        gap("base_rate").alias("base_rate_gap"),
    )
    return found.withColumn("within_limit", F.col("selection_rate_gap") <= F.lit(limit))


def flat(gap_rows: DataFrame) -> DataFrame:
    """``metric, value`` rows, as a run log stores them."""
    # Names of the logged metrics.
    named = {
        "selection_gap": "selection_rate_gap",
        "equal_opportunity_gap": "equal_opportunity_gap",
    }
    rows = [
        F.struct(
            F.concat(F.lit("fairness_"), "attribute", F.lit(f"_{short}")).alias("metric"),
            F.col(column).alias("value"),
        )
        for short, column in named.items()
    ]
    return gap_rows.select(F.inline(F.array(*rows)))
