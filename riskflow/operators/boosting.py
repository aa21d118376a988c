"""Second-order boosted trees, fitted side by side as bounded tasks.

Splits follow gradients and hessians of the log loss, with ridge and lasso penalties on
leaf weights and a least hessian per leaf. Trees grow on quantile bins of a bounded
sample of labelled rows, which is small enough to be sent to every task: its size is a
parameter. What is distributed is the fits: each pair of
parameter set and fold is a task of its own, so a search over thirty sets and three
folds costs a task the time of one fit, not one Spark job per round. Scores run over
all rows, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import catalog


@dataclass(frozen=True)
class Params:
    """What shapes a model. Defaults are fixed values: the hand-picked start of the search."""

    rounds: int = 400
    step: float = 0.05
    depth: int = 4
    rows: float = 0.8
    columns: float = 0.8
    least_hessian: float = 1.0
    ridge: float = 1.0
    lasso: float = 0.0


#: Low end, high end and scale of what the search draws.
SPACE = {
    "rounds": (200, 900, "hundreds"),
    "depth": (2, 7, "whole"),
    "step": (0.01, 0.2, "log"),
    "rows": (0.6, 1.0, "even"),
    "columns": (0.5, 1.0, "even"),
    "least_hessian": (1, 20, "whole"),
    "ridge": (0.001, 10.0, "log"),
    "lasso": (0.001, 10.0, "log"),
}

#: Rows a model is fitted on at most, and bins per column.
SAMPLE = 20_000
BINS = 64


@dataclass(frozen=True)
class Sample:
    """A bounded sample in bins: one byte per row and column, with labels and folds."""

    columns: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray


def draw_sample(
    df: DataFrame, key: str, label: str, columns: Sequence[str], most: int = SAMPLE, seed: int = catalog.SEED, fold: str | None = None
) -> Sample:
    """At most ``most`` rows by the smallest hashes of the key, the same for any layout.

    Nulls go to the first bin of a column, below all values. ``fold`` names a column of
    fold numbers, which stay with the rows.
    """
    code = F.xxhash64(F.lit(seed), F.col(key)).alias("_code")
    extra = F.col(fold) if fold else F.lit(0)
    wanted = [F.col(c).cast("double").alias(c) for c in columns]
    rows = df.select(code, F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), extra.cast("int").alias("_fold"), *wanted)
    rows = rows.filter("_label IS NOT NULL").orderBy("_code", "_key").limit(most).toPandas()
    x = rows[list(columns)].to_numpy(np.float64)
    edges, bins = [], np.zeros(x.shape, np.uint8)
    for i in range(x.shape[1]):
        seen = np.unique(x[:, i][~np.isnan(x[:, i])])
        # A cut between neighbouring values; with many values, between quantiles of them.
        if len(seen) > BINS - 1:
            at = np.quantile(x[:, i][~np.isnan(x[:, i])], np.linspace(0, 1, BINS)[1:-1], method="lower")
            cuts = np.unique(at)
        else:
            cuts = (seen[1:] + seen[:-1]) / 2 if len(seen) > 1 else np.zeros(0)
        edges.append(cuts)
        bins[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(cuts, x[:, i], "left")).astype(np.uint8)
    return Sample(tuple(columns), tuple(edges), bins, rows["_label"].to_numpy(np.float64), rows["_fold"].to_numpy())


def leaf_weight(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    """The weight that lowers the penalised second-order loss the most."""
    pulled = np.sign(g) * np.maximum(np.abs(g) - p.lasso, 0)
    return -pulled / (h + p.ridge)


def leaf_gain(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    """Twice what that weight takes from the loss."""
    pulled = np.maximum(np.abs(g) - p.lasso, 0)
    return pulled * pulled / (h + p.ridge)


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """One tree as arrays over heap positions (children of i are 2i + 1 and 2i + 2).

    Each level sums gradients and hessians by (node, column, bin) in one pass.
    """
    size = 2 ** (p.depth + 1) - 1
    column, cut = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    value, cover = np.zeros(size), np.zeros(size)
    node = np.zeros(len(g), np.int64)
    for level in range(p.depth + 1):
        first, n = 2**level - 1, 2**level
        live = np.flatnonzero(node >= first)
        at = node[live] - first
        total_g, total_h = np.bincount(at, g[live], n), np.bincount(at, h[live], n)
        value[first : first + n] = leaf_weight(total_g, total_h, p)
        cover[first : first + n] = total_h
        if level == p.depth or not len(live):
            break
        k = len(allowed)
        place = ((at[:, None] * k + np.arange(k)) * BINS + bins[live][:, allowed]).ravel()
        left_g, left_h = (np.bincount(place, np.repeat(x[live], k), n * k * BINS).reshape(n, k, BINS).cumsum(2) for x in (g, h))
        right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
        gain = leaf_gain(left_g, left_h, p) + leaf_gain(right_g, right_h, p) - leaf_gain(total_g, total_h, p)[:, None, None]
        gain = np.where((left_h < p.least_hessian) | (right_h < p.least_hessian), 0, gain).reshape(n, k * BINS)
        # Of equal gains the first column and cut; rounding alone is no gain.
        found = gain.argmax(1)
        better = gain[np.arange(n), found] > 1e-9
        column[first : first + n][better] = allowed[found[better] // BINS]
        cut[first : first + n][better] = found[better] % BINS
        split = column[first : first + n][at] >= 0
        rows, where = live[split], node[live][split]
        right = bins[rows, column[where]] > cut[where]
        node[rows] = 2 * where + 1 + right
        # Rows of finished leaves take no part in deeper levels.
        node[live[~split]] = -1
        if not split.any():
            break
    return {"column": column, "cut": cut, "value": value * p.step, "cover": cover}


def _leaves(tree: Mapping[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    while True:
        c = tree["column"][node]
        inner = c >= 0
        if not inner.any():
            return tree["value"][node]
        at = np.flatnonzero(inner)
        node[at] = 2 * node[at] + 1 + (bins[at, c[at]] > tree["cut"][node[at]])


def boost(bins: np.ndarray, label: np.ndarray, p: Params, seed: int = catalog.SEED) -> tuple[float, list[dict[str, np.ndarray]]]:
    """Base margin and trees. Rows and columns of each tree are drawn from the seed and its number."""
    rate = min(max(label.mean() if len(label) else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    margin, trees = np.full(len(label), base), []
    for i in range(p.rounds):
        draw = np.random.default_rng([seed, i])
        chance = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(draw.random(len(label)) < p.rows) if p.rows < 1 else np.arange(len(label))
        some = max(1, round(p.columns * bins.shape[1]))
        allowed = np.sort(draw.permutation(bins.shape[1])[:some])
        tree = _grow(bins[rows], (chance - label)[rows], (chance * (1 - chance))[rows], allowed, p)
        margin += _leaves(tree, bins)
        trees.append(tree)
    return base, trees


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: trees over raw columns, a split sends values up to the cut to the left, nulls too."""

    columns: tuple[str, ...]
    base: float
    trees: tuple[dict, ...]

    def margins(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Log-odds of every row, in Arrow batches."""
        columns, base = self.columns, self.base
        nodes = [{k: np.asarray(v) for k, v in t.items()} for t in self.trees]

        @F.pandas_udf("double")
        def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                # One column alone comes as a series.
                x = np.column_stack([c.to_numpy(np.float64) for c in (batch if isinstance(batch, tuple) else (batch,))])
                x = np.where(np.isnan(x), -np.inf, x)
                total = np.full(len(x), base)
                for t in nodes:
                    node = np.zeros(len(x), np.int64)
                    while True:
                        at = np.flatnonzero(t["column"][node] >= 0)
                        if not len(at):
                            break
                        c = t["column"][node[at]]
                        node[at] = 2 * node[at] + 1 + (x[at, c] > t["threshold"][node[at]])
                    total += t["value"][node]
                yield pd.Series(total)

        return df.withColumn(name, of(*[F.col(c).cast("double") for c in columns]))

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Adds the probability; all other columns stay."""
        made = self.margins(df, "_margin")
        return made.withColumn(name, 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")

    def gains(self, spark: SparkSession) -> DataFrame:
        """(column, splits, hessian): how often each column splits, and the hessian that its splits divide."""
        splits = {c: [0, 0.0] for c in self.columns}
        for t in self.trees:
            for c, h in zip(t["column"], t["cover"], strict=True):
                if c >= 0:
                    splits[self.columns[c]][0] += 1
                    splits[self.columns[c]][1] += float(h)
        rows = [(c, n, h) for c, (n, h) in splits.items()]
        return spark.createDataFrame(rows, "column string, splits long, hessian double")

    def tables(self, spark: SparkSession) -> DataFrame:
        """(tree, node, column, threshold, value): the model as rows, to keep or to check in SQL."""
        rows = []
        for i, t in enumerate(self.trees):
            for k, (c, x, v) in enumerate(zip(t["column"], t["threshold"], t["value"], strict=True)):
                rows.append((i, k, self.columns[c] if c >= 0 else None, float(x) if c >= 0 else None, float(v)))
        return spark.createDataFrame(rows, "tree int, node int, column string, threshold double, value double")


def _named(sample: Sample, base: float, trees: list[dict]) -> BoostedTrees:
    made = []
    for t in trees:
        x = np.zeros(len(t["column"]))
        for i, c in enumerate(t["column"]):
            if c >= 0:
                cuts = sample.edges[c]
                k = t["cut"][i] - 1
                # Bin 0 holds nulls alone; the last bin has no end.
                x[i] = -np.inf if k < 0 else cuts[k] if k < len(cuts) else np.inf
        made.append({"column": t["column"], "threshold": x, "value": t["value"], "cover": t["cover"]})
    return BoostedTrees(sample.columns, base, tuple(made))


def fit(sample: Sample, params: Params | None = None, seed: int = catalog.SEED) -> BoostedTrees:
    """One model, in one task's time; see ``cross_fit`` for many."""
    params = params or Params()
    return _named(sample, *boost(sample.bins, sample.label, params, seed))


def cross_fit(spark: SparkSession, sample: Sample, trials: Mapping[str, Params], folds: int, seed: int = catalog.SEED) -> DataFrame:
    """(trial, fold, row, label, margin): out-of-fold margins of every trial, all fits side by side.

    The sample is broadcast: ``draw_sample`` bounds it. A (trial, fold) is a task; a lost
    task is fitted again and gives the same numbers.
    """
    jobs = [(name, k, json.dumps(asdict(p))) for name, p in trials.items() for k in range(folds)]
    work = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "job int, trial string, fold int, params string")
    work = work.repartitionByRange(len(jobs), "job")
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = shared.value
        for batch in batches:
            for job in batch.itertuples():
                held = data.fold == job.fold
                base, trees = boost(data.bins[~held], data.label[~held], Params(**json.loads(job.params)), seed)
                margin = np.full(int(held.sum()), base)
                for t in trees:
                    margin += _leaves(t, data.bins[held])
                yield pd.DataFrame(
                    {"trial": job.trial, "fold": job.fold, "row": np.flatnonzero(held), "label": data.label[held].astype(np.int32), "margin": margin}
                )

    return work.mapInPandas(run, "trial string, fold int, row long, label int, margin double")


def _unit(name: str, value: float) -> float:
    """Where a value lies in its range, from 0 to 1; values outside are at an end."""
    low, high, scale = SPACE[name]
    value = min(max(value, low), high)
    return float(np.log(value / low) / np.log(high / low)) if scale == "log" else (value - low) / (high - low)


def _from_unit(name: str, u: float) -> float:
    low, high, scale = SPACE[name]
    u = min(max(float(u), 0.0), 1.0)
    if scale == "log":
        return float(low * (high / low) ** u)
    if scale == "even":
        return float(low + (high - low) * u)
    unit = 100 if scale == "hundreds" else 1
    return int(low + unit * min(int(u * ((high - low) // unit + 1)), (high - low) // unit))


def propose(seen: Sequence[tuple[Params, float]], n: int, batch: int, seed: int = catalog.SEED, draws: int = 24, warm: int = 10) -> list[Params]:
    """The next ``n`` parameter sets by a tree-structured Parzen estimator.

    Tried sets are split into the best quarter and the rest; each parameter has a density
    of either, kernels around the tried values with a flat one among them, and of
    ``draws`` values from the good density the one with the best ratio is taken. The
    first ``warm`` sets are drawn evenly. Depends on nothing but its arguments.
    """
    ranked = sorted(seen, key=lambda x: -x[1])
    split = max(1, round(len(ranked) / 4))
    made = []
    for i in range(n):
        draw = np.random.default_rng([seed, batch, i])
        chosen = {}
        for name in SPACE:
            if len(ranked) < warm:
                chosen[name] = _from_unit(name, draw.random())
                continue
            good, rest = (np.array([_unit(name, getattr(p, name)) for p, _ in part]) for part in (ranked[:split], ranked[split:]))
            width = {id(x): max(0.1, 1.06 * x.std() * len(x) ** -0.2) for x in (good, rest)}

            def density(u: np.ndarray, x: np.ndarray) -> np.ndarray:
                s = width[id(x)]
                bell = np.exp(-0.5 * ((u[:, None] - x) / s) ** 2) / (s * np.sqrt(2 * np.pi))
                return (bell.sum(1) + 1) / (len(x) + 1)

            centre = good[draw.integers(0, len(good), draws)]
            u = np.where(draw.random(draws) < 1 / (len(good) + 1), draw.random(draws), centre + width[id(good)] * draw.standard_normal(draws))
            u = np.clip(u, 0, 1)
            chosen[name] = _from_unit(name, u[np.argmax(density(u, good) / density(u, rest))])
        made.append(Params(**chosen))
    return made

