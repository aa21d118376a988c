"""Exact additive attributions for boosted trees.

A leaf pays its value if the row meets every condition on its path. Seen as a game
in which the features of the path join one by one, a feature that is in sets its
own condition, and one that is out stands for the share of training rows that
went that way. The Shapley value of that product game has a short closed form, so
the attribution of a row is a sum over leaves. It depends only on which conditions
hold, so each leaf has a table of its gains for all combinations of them. Leaves and
tables are of the size of the model and go to every task; rows are handled in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators.model import Scorer, contribution


#: Features of a path up to which its gains are looked up: two to that power are held per feature.
MOST_TABLED = 8


class Leaf(NamedTuple):
    """A leaf: its value, and per feature of its path the interval and the share of rows."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves_of(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of the ensemble, weighted as in the margin. The log-odds are twice
    the sum of the trees."""
    found: list[Leaf] = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        _walk(tree._java_obj.rootNode(), 2.0 * weight, {}, found)
    return found


def _walk(node, weight: float, path: dict, found: list[Leaf]) -> None:
    if node.subtreeDepth() == 0:
        names = tuple(path)
        low, high, share = zip(*path.values(), strict=True) if path else ((), (), ())
        found.append(Leaf(weight * node.prediction(), names, low, high, share))
        return
    feature, cut = node.split().featureIndex(), node.split().threshold()
    rows = node.impurityStats().count()
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        part = child.impurityStats().count() / rows
        limits = (low, min(high, cut)) if left else (max(low, cut), high)
        _walk(child, weight, {**path, feature: (*limits, share * part)}, found)


def _gains(met: np.ndarray, value: float, share: Sequence[float]) -> np.ndarray:
    """What each feature of a leaf's path adds, a row per row of ``met``: which conditions hold."""
    m = len(share)
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    out = np.empty((len(met), m))
    for j in range(m):
        # Coefficient s: total product over the groups of s other features that are in.
        groups = np.zeros((len(met), m))
        groups[:, 0] = 1.0
        for i in range(m):
            if i != j:
                joined = groups[:, :-1] * met[:, [i]]
                groups *= share[i]
                groups[:, 1:] += joined
        out[:, j] = value * (met[:, j] - share[j]) * (groups @ weights)
    return out


def gain_tables(leaves: Sequence[Leaf]) -> list[np.ndarray | None]:
    """Per leaf the gains for every combination of conditions that hold, one row per feature;
    none for a path of more than ``MOST_TABLED`` features."""
    bits = {m: (np.arange(2**m)[:, None] >> np.arange(m) & 1).astype(float) for m in range(MOST_TABLED + 1)}
    return [
        np.ascontiguousarray(_gains(bits[len(share)], value, share).T) if len(share) <= MOST_TABLED else None
        for value, _, _, _, share in leaves
    ]


def attribute(
    x: np.ndarray,
    leaves: Sequence[Leaf],
    source: np.ndarray,
    n: int,
    tables: Sequence[np.ndarray | None] | None = None,
) -> np.ndarray:
    """Rows of ``n`` source attributions, then the base value in the last column.

    The gains of a leaf depend only on which of its conditions hold, so a row looks them
    up in the leaf's table; ``tables`` are those of ``gain_tables``.
    """
    tables = gain_tables(leaves) if tables is None else tables
    columns, out = np.ascontiguousarray(x.T), np.zeros((n + 1, len(x)))
    for (value, features, low, high, share), table in zip(leaves, tables, strict=True):
        out[n] += value * np.prod(share)
        met = [(columns[f] > a) & (columns[f] <= b) for f, a, b in zip(features, low, high, strict=True)]
        if table is None:
            gains = _gains(np.column_stack(met).astype(float), value, share).T
        else:
            code = np.zeros(len(x), np.intp)
            for j, holds in enumerate(met):
                code |= holds.astype(np.intp) << j
            gains = [row.take(code) for row in table]
        for f, gain in zip(features, gains, strict=True):
            out[source[f]] += gain
    return out.T


def tree_contributions(scorer: Scorer, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``contributions`` per source column, ``base`` and the model's ``margin`` per row."""
    sources = list(dict.fromkeys(scorer.encoding.sources()))
    place = np.array([sources.index(s) for s in scorer.encoding.sources()])
    leaves = [tuple(leaf) for leaf in leaves_of(scorer.model)]
    shared = df.sparkSession.sparkContext.broadcast((leaves, place, gain_tables(leaves)))
    kept = list(dict.fromkeys([*keys, *sources]))
    rows = scorer.pipeline.transform(df).select(
        *kept,
        vector_to_array("_features").alias("_x"),
        # The log-odds: the raw column is (-margin, margin) of the halved scale.
        (2 * vector_to_array("_raw")[1]).alias("margin"),
    )
    width = len(sources)
    schema = T.StructType(
        [*rows.drop("_x").schema.fields, T.StructField("_a", T.ArrayType(T.DoubleType()))]
    )

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves, where, tables = shared.value
        for batch in batches:
            x = np.array(batch["_x"].tolist(), dtype=float).reshape(len(batch), -1)
            made = attribute(x, leaves, where, width, tables)
            yield batch.drop(columns="_x").assign(_a=list(made))

    explained = rows.mapInPandas(explain, schema)
    parts = [contribution(s, F.col(s), F.col("_a")[i]) for i, s in enumerate(sources)]
    return explained.select(
        *keys, F.array(*parts).alias("contributions"), F.col("_a")[width].alias("base"), "margin"
    )
