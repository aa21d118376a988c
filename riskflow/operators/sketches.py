"""Mergeable sketches: kept per pane or day, merged into any span without the rows.

Quantile sketches (KLL) bound the error of a rank, membership sketches (theta) the
error of a count. Both are partial aggregates, so rows fold before they shuffle and a
busy pane is a few kilobytes, not a buffer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a quantile sketch; the error of a rank falls with them.
RANK_ENTRIES = 800
#: Base-2 logarithm of a membership sketch's entries; counts up to that many are exact.
MEMBER_BITS = 14


def rank_error(entries: int = RANK_ENTRIES, certainty: float = 2.0) -> float:
    """Error of a rank as a share of all rows.

    The published bound holds with 99 %; ``certainty`` widens it, 2 for one miss in a million.
    """
    # The published fit of the error to the number of entries.
    return certainty * 2.296 / entries**0.9021


def quantile_parts(value: str, entries: int = RANK_ENTRIES) -> list[Column]:
    """Aggregates of a pane: its number of values and their sketch. Nulls and NaN stay out."""
    given = F.col(value).cast("double")
    given = F.when(~F.isnan(given), given)
    return [F.count(given).alias("n"), F.kll_sketch_agg_double(given, entries).alias("sketch")]


def merged_quantiles(
    panes: DataFrame,
    probs: Mapping[str, float],
    pane: int,
    size: int,
    slide: int | None = None,
    by: Sequence[str] = (),
    entries: int = RANK_ENTRIES,
) -> DataFrame:
    """Quantiles of windows of ``size`` minutes from panes of ``pane`` minutes (window_start, n, sketch).

    A window starts every ``slide`` minutes, every ``size`` if none is given. Panes may
    come in several rows each, as a stream in update mode would store increments of them.
    Windows without values have null quantiles.
    """
    slide = slide or size
    if size % slide or slide % pane:
        raise ValueError("the window must be a multiple of the slide, the slide of the pane")
    at = F.unix_seconds(F.col("window_start").cast("timestamp"))
    last = at - F.pmod(at, F.lit(slide * 60))
    starts = F.sequence(last - (size - slide) * 60, last, F.lit(slide * 60))
    spread = panes.select(*by, "n", "sketch", F.explode(starts).alias("_at"))
    merged = spread.groupBy(*by, "_at").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", entries).alias("_all")
    )
    picks = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_all", F.lit(float(q)))).alias(name)
        for name, q in probs.items()
    ]
    start = F.timestamp_seconds("_at").cast("timestamp_ntz").alias("window_start")
    return merged.select(*by, start, "n", *picks)


def member_sketches(rows: DataFrame, span: Column, key: str, bits: int = MEMBER_BITS) -> DataFrame:
    """One membership sketch per span of time: (span, members). Null keys are nobody."""
    found = rows.where(F.col(key).isNotNull())
    return found.groupBy(span.alias("span")).agg(F.theta_sketch_agg(key, bits).alias("members"))


def union_of(sketches: DataFrame, within: Column, name: str, bits: int = MEMBER_BITS) -> Column:
    """Members of all spans that meet a condition, as an aggregate over ``sketches``."""
    return F.theta_union_agg(F.when(within, sketches["members"]), bits).alias(name)


def changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Sizes of two sketches and of what came, stayed and went, in place of the sketches.

    A missing sketch is an empty one. Up to the sketch's entries the counts are exact;
    beyond them the error of each is about the size of the union over the root of the entries.
    """
    old, new = F.col(before), F.col(after)
    rest = [c for c in pairs.columns if c not in (before, after)]

    def size(sketch: Column, missing: Column) -> Column:
        return F.coalesce(F.theta_sketch_estimate(sketch), missing).cast("bigint")

    none = F.lit(0)
    sizes = pairs.select(
        *rest,
        size(old, none).alias("before"),
        size(new, none).alias("after"),
        size(F.theta_intersection(old, new), none).alias("kept"),
        size(F.theta_difference(new, old), F.theta_sketch_estimate(new)).alias("came"),
        size(F.theta_difference(old, new), F.theta_sketch_estimate(old)).alias("went"),
    )
    return sizes.fillna(0, ["came", "went"])
