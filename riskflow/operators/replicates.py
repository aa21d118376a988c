"""Average precision of many re-weighted copies of one table, without the copies.

A bootstrap or a sweep asks for the same metric under hundreds of weightings. Here
the folded cells are shuffled once, by range of the score. A task walks through the
weightings of its range with numpy vectors, twice: first for the totals of the
range, then, knowing what the higher ranges hold, for its part of the metric.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.prefix import _RANGE, with_range

# For a range: weighting number -> positives and negatives per distinct score, highest first.
Weighting = Callable[[int], tuple[np.ndarray, np.ndarray]]
Prepare = Callable[[pd.DataFrame, int], Weighting]

_TOTALS = f"{_RANGE} int, replicate int, tp double, fp double"
_PARTS = "replicate int, part double, positives double, negatives double"


def by_score(score: pd.Series) -> tuple[int, np.ndarray]:
    """Number of distinct scores and, per row, the place of its score from the top."""
    distinct, place = np.unique(-score.to_numpy(dtype=float), return_inverse=True)
    return len(distinct), place


def replicate_pr_auc(
    cells: DataFrame,
    score: str,
    replicates: int,
    prepare: Prepare,
    bounds: Sequence[float],
) -> DataFrame:
    """``replicate, pr_auc`` for weightings 0..replicates-1; null where one class is absent."""
    ranged = with_range(cells, score, bounds)

    def totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weigh = prepare(rows, key[0])
        sums = [[part.sum() for part in weigh(r)] for r in range(replicates)]
        made = pd.DataFrame(sums, columns=["tp", "fp"])
        return made.assign(**{_RANGE: key[0], "replicate": range(replicates)})[
            [_RANGE, "replicate", "tp", "fp"]
        ]

    # As many rows as ranges times weightings, both fixed in the plan.
    held = ranged.groupBy(_RANGE).applyInPandas(totals, _TOTALS)
    order = Window.partitionBy("replicate").orderBy(F.col(_RANGE).desc())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("replicate")
    offsets = held.select(
        _RANGE,
        "replicate",
        F.coalesce(F.sum("tp").over(above), F.lit(0.0)).alias("off_tp"),
        F.coalesce(F.sum("fp").over(above), F.lit(0.0)).alias("off_fp"),
        F.sum("tp").over(whole).alias("all_tp"),
        F.sum("fp").over(whole).alias("all_fp"),
    )

    def part(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        weigh = prepare(rows, key[0])
        out = []
        for o in known.itertuples(index=False):
            tp, fp = weigh(o.replicate)
            upto_tp = o.off_tp + np.cumsum(tp)
            reached = upto_tp + o.off_fp + np.cumsum(fp)
            hit = tp > 0
            precision = upto_tp[hit] / reached[hit]
            out.append((o.replicate, float(tp[hit] @ precision), o.all_tp, o.all_fp))
        return pd.DataFrame(out, columns=["replicate", "part", "positives", "negatives"])

    parts = (
        ranged.groupBy(_RANGE).cogroup(offsets.groupBy(_RANGE)).applyInPandas(part, _PARTS)
    )
    found = parts.groupBy("replicate").agg(
        F.sum("part").alias("_part"), F.max("positives").alias("_p"), F.max("negatives").alias("_n")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return found.select("replicate", F.when(both, F.col("_part") / F.col("_p")).alias("pr_auc"))


#: Score blocks of a resample (a power of two) and draws made at a time. Neither depends on the data.
BLOCKS, BUNCH = 1 << 12, 8


def block_of(score: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """Equal parts of [0, 1]; scores beyond it belong to the first or last part."""
    return np.minimum(np.floor(np.clip(score, 0.0, 1.0) * blocks), blocks - 1).astype(np.int64)


def whole_blocks(bounds: Sequence[float], blocks: int = BLOCKS) -> list[float]:
    """The boundaries moved down to edges of blocks, so that a range holds whole blocks."""
    return sorted({float(b) / blocks for b in block_of(np.array(bounds, dtype=float), blocks) if b > 0})


def block_counts(cells: DataFrame, score: str, count: str, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Rows per block, at most ``blocks`` pairs, which the driver hands to every task."""
    part = F.greatest(F.least(F.floor(F.col(score) * F.lit(float(blocks))), F.lit(blocks - 1)), F.lit(0))
    rows = cells.groupBy(part.alias("block")).agg(F.sum(count).alias("n")).collect()
    known = sorted((r["block"], r["n"]) for r in rows)
    return np.array([b for b, _ in known], dtype=np.int64), np.array([n for _, n in known], dtype=np.int64)


def _source(*key: int) -> np.random.Generator:
    """Random numbers that depend on the key alone."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def resample_weights(
    seed: int,
    score: str,
    label: str,
    weight: str,
    count: str,
    known: tuple[np.ndarray, np.ndarray],
    blocks: int = BLOCKS,
) -> Prepare:
    """A bootstrap draw of exactly as many rows as there are, in two steps.

    All rows are dealt to the score blocks at once (the same numbers in every task), a
    block's share to its cells in the order of their values. Both are binomial splits whose
    source is seeded by seed, draws and block; ranges must hold whole blocks (``whole_blocks``).
    So any layout of the data draws the same, and the size of a cell changes no law.
    """
    ids, sizes = known

    def prepare(rows: pd.DataFrame, number: int) -> Weighting:
        rows = rows.sort_values([score, label, weight], kind="stable")
        n, place = by_score(rows[score])
        size = rows[count].to_numpy(dtype=np.int64)
        w = rows[weight].to_numpy(dtype=float)
        positive = rows[label].to_numpy() == 1
        here, start = np.unique(block_of(rows[score].to_numpy(dtype=float), blocks), return_index=True)
        ends, at = np.append(start[1:], len(rows)), np.searchsorted(ids, here)
        held: dict[int, np.ndarray] = {}

        def bunch(number: int) -> np.ndarray:
            total = np.full(BUNCH, sizes.sum())
            share = _source(seed, number).multinomial(total, sizes / sizes.sum())
            made = np.empty((BUNCH, len(rows)))
            for block, a, z, i in zip(here, start, ends, at, strict=True):
                if z - a == 1:
                    made[:, a] = share[:, i]
                    continue
                split = size[a:z] / size[a:z].sum()
                made[:, a:z] = _source(seed, number, int(block) + 1).multinomial(share[:, i], split)
            return made

        def weigh(r: int) -> tuple[np.ndarray, np.ndarray]:
            number, i = divmod(r, BUNCH)
            if number not in held:
                held.clear()
                held[number] = bunch(number)
            drawn = w * held[number][i]
            return (
                np.bincount(place, drawn * positive, n),
                np.bincount(place, drawn * ~positive, n),
            )

        return weigh

    return prepare


def replicate_totals(
    cells: DataFrame, score: str, replicates: int, prepare: Prepare, bounds: Sequence[float]
) -> DataFrame:
    """``replicate, positives, negatives``: the weight that each weighting gives to either class."""

    def totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weigh = prepare(rows, key[0])
        sums = [(r, *[part.sum() for part in weigh(r)]) for r in range(replicates)]
        return pd.DataFrame(sums, columns=["replicate", "tp", "fp"])

    held = with_range(cells, score, bounds).groupBy(_RANGE).applyInPandas(totals, "replicate int, tp double, fp double")
    return held.groupBy("replicate").agg(F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"))


def holdout_weights(rates: Sequence[float], draws: int, score: str) -> Prepare:
    """Weighting ``slot * draws + draw`` adds the declined rows of that draw, taken at that
    rate, to the approved rows (draw -1), each weighted by the inverse of its chance."""

    def prepare(rows: pd.DataFrame, number: int) -> Weighting:
        n, place = by_score(rows[score])
        count = rows["n"].to_numpy(dtype=float)
        positive = rows["label"].to_numpy() == 1
        draw, first = rows["draw"].to_numpy(), rows["first"].to_numpy()
        base = draw < 0
        fixed = [np.bincount(place[base & s], count[base & s], n) for s in (positive, ~positive)]
        drawn = {d: np.flatnonzero(draw == d) for d in range(draws)}

        def weigh(r: int) -> tuple[np.ndarray, np.ndarray]:
            slot, d = divmod(r, draws)
            at = drawn[d][first[drawn[d]] <= slot]
            w, hit = count[at] / rates[slot], positive[at]
            return (
                fixed[0] + np.bincount(place[at[hit]], w[hit], n),
                fixed[1] + np.bincount(place[at[~hit]], w[~hit], n),
            )

        return weigh

    return prepare
