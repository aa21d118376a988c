"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text: counts of single words, word pairs and marks, hashed into 2^18
places, as log(1 + count) scaled to length 1; and one place for the share of word
triples that repeat earlier ones, in eighths. Training reads a bounded sample, dealt
into a fixed number of shards that learn side by side; the model is the mean of
their weights. A score is one sparse dot product per text inside a vectorised UDF.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import held_out, labelled_sample, sampled_texts

PLACES = 1 << 18
LEVELS = 9  # of repetition
BIAS = PLACES + LEVELS
WIDTH = BIAS + 1

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Hash of a token, remembered; forgets everything when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[token] = zlib.crc32(token.encode())
        return code


_codes = _Codes()


def featurise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one whole text. An empty one has only the bias and no repetition."""
    tokens = _TOKEN.findall(text)
    ids = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (ids[:-1] * _MIX) ^ ids[1:]
    triples = (pairs[:-1] * _MIX) ^ ids[2:]
    again = 0
    if len(triples):
        again = int((LEVELS - 1) * (1 - len(np.unique(triples)) / len(triples)))
    grams = np.concatenate([ids * _MIX, pairs * _MIX]) >> np.uint64(46)
    places, counts = np.unique(grams.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    if len(values):
        values /= np.sqrt((values * values).sum())
    return np.append(places, [PLACES + again, BIAS]), np.append(values, [1.0, 1.0])


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate learning rates and lazy L1; the defaults suit values of unit length."""

    alpha: float = 1.0
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.01
    passes: int = 3

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
        z, n = np.zeros(WIDTH), np.zeros(WIDTH)
        for _ in range(self.passes):
            for (at, x), y in zip(rows, labels, strict=True):
                w = self.weights(z[at], n[at])
                g = (_sigmoid(w @ x) - y) * x
                more = n[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / self.alpha * w
                n[at] = more
        return self.weights(z, n)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    column: str = "quality",
    without: Column | None = None,
    rows: int = 16_384,
    shards: int = 8,
    ftrl: Ftrl | None = None,
    seed: int = 4,
) -> np.ndarray | None:
    """Weights from at most ``rows`` labelled documents, None if there are none.

    ``without`` marks label rows that must not be learned from. A shard is at most a
    few thousand texts, whatever the size of the tables; only the weights, a fixed
    number, come to the driver.
    """
    ftrl = ftrl or Ftrl()
    none = F.lit(False) if without is None else without
    sample = labelled_sample(labels, column, none, rows, seed)
    texts = sampled_texts(docs, sample).withColumn("shard", F.pmod("draw", F.lit(shards)))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "doc_id"])
        w = ftrl.train([featurise(t) for t in part["text"]], part["label"].tolist())
        at = np.flatnonzero(w)
        places, weights = np.append(at, -1), np.append(w[at], float(len(part)))
        return pd.DataFrame({"place": places, "weight": weights})

    parts = texts.groupBy("shard").applyInPandas(learn, "place long, weight double")
    # Place -1 counts a shard's documents; shards learn from about equally many.
    summed = parts.groupBy("place").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).toPandas()
    if summed.empty:
        return None
    mean = np.zeros(WIDTH, np.float32)
    trained = int(summed.loc[summed["place"] == -1, "n"].iloc[0])
    own = summed[summed["place"] >= 0]
    mean[own["place"].to_numpy()] = np.round(own["w"].to_numpy() / trained, 6)
    return mean


def quality_score(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> Column:
    """A score from 0 to 1 of each whole text; 1 for all when nothing could be learned."""
    if weights is None:
        return F.lit(1.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for batch in batches:
            made = np.empty(len(batch))
            for i, t in enumerate(batch):
                at, x = featurise(t or "")
                made[i] = _sigmoid(float(w[at] @ x))
            yield pd.Series(made)

    return score(F.coalesce(F.col(text), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents with held_out, score and predicted.

    Labels are learned only from ids whose crc32 modulo 4 is not 2. Neither labels nor
    lang, source or doc_id enter a score. A null text scores like an empty one; long
    texts are read whole; repeated rows score alike. An empty document table gives no
    rows, an empty label table scores 1. Input columns named like added ones are replaced.
    """
    weights = fit_quality(docs, labels, without=held_out(4, 2))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*kept, held_out(4, 2).alias("held_out"), quality_score(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
