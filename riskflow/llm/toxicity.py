"""Toxicity: maximum-scoring passages over token log-odds, judged by extreme values.

1. Labelled documents, a bounded sample, are counted by class and word and by the
   word's first letters. A word's toxic share is smoothed towards that of its stem,
   the stem's towards a shorter one, and so on to the base rate: a chain of
   Dirichlet priors. The log-odds against the base rate, less their standard error
   (``caution`` of it) and a drift that makes an ordinary word cost something, score
   a token.
2. A linear scan (Ruzzo and Tompa) finds all maximal-scoring runs of a whole text.
3. On labelled documents that were not counted, the best runs of clean texts fit an
   extreme-value law ``P(best > s) = 1 - exp(-K n exp(-lambda s))`` for n words. A
   run is a toxic passage if it is expected less than ``expect`` times in a text of
   that length; a document's evidence is its best run and the sum over passages,
   and a logistic curve over both turns it into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import held_out, labelled_sample, sampled_texts

PLACES = 1 << 19
STEMS = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W_]+")

RESULT = "score double, starts array<int>, ends array<int>, expected array<double>"


def units(word: str) -> list[int]:
    """Places of the stems, shortest first, and of the word itself."""
    keys = [f"{k}:{word[:k]}" for k in STEMS if len(word) > k]
    return [zlib.crc32(k.encode()) & (PLACES - 1) for k in [*keys, f"={word}"]]


class _Units(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = units(word)
        return found


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def maximal_runs(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (start, end, sum), in order; one pass over the positive tokens."""
    good = np.flatnonzero(scores > 0)
    if not len(good):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    cut = np.flatnonzero(np.diff(good) > 1)
    first = good[np.append(0, cut + 1)]
    last = good[np.append(cut, len(good) - 1)] + 1
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, link
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        low, high = total[a], total[b]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((a, b, low, high, j))
                break
            a, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in kept]


@dataclass(frozen=True)
class Toxicity:
    """Counts by place, base rate, extreme-value law and logistic curve."""

    toxic: np.ndarray
    clean: np.ndarray
    base: float
    mass: float
    drift: float
    caution: float = 1.0
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    expect: float = 0.05

    def scorer(self):
        """A dictionary that scores words as they come; forgets everything when it has grown large."""
        toxic, clean = memoryview(self.toxic), memoryview(self.clean)
        base, mass, caution = self.base, self.mass, self.caution
        offset = math.log(base / (1 - base)) + self.drift
        places, longest = PLACES - 1, max(STEMS)
        stems: dict[str, tuple[float, float]] = {}

        def after(keys: list[str], share: float, doubt: float) -> tuple[float, float]:
            """Toxic share and its standard error after the counts of these keys."""
            for key in keys:
                u = zlib.crc32(key.encode()) & places
                t, n = toxic[u], toxic[u] + clean[u] + mass
                share = (t + mass * share) / n
                own = (t + mass * base) / n
                doubt = caution / math.sqrt(n * own * (1 - own))
            return share, doubt

        class Scores(dict):
            def __missing__(own, word: str) -> float:  # noqa: N805
                if len(own) > 400_000:
                    own.clear()
                    stems.clear()
                # Long words with the same first letters share what their stems say.
                stem = word[:longest] + "~" if len(word) > longest else word
                if stem not in stems:
                    stems[stem] = after([f"{k}:{word[:k]}" for k in STEMS if len(word) > k], base, 0.0)
                share, doubt = after([f"={word}"], *stems[stem])
                found = own[word] = math.log(share / (1 - share)) - offset - doubt
                return found

        return Scores()

    def runs(self, text: str, scorer) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        scores = np.fromiter(map(scorer.__getitem__, words), float, len(words))
        # Words were counted once per text, so the k-th time one is worth a k-th.
        seen: dict[str, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():
            k = seen[words[i]] = seen.get(words[i], 0) + 1
            if k > 1:
                scores[i] /= k
        return len(words), maximal_runs(scores)

    def expected(self, n: int, score: float) -> float:
        """How often a clean text of n words has a run as good as this."""
        return float(np.exp(np.clip(self.log_k + np.log(max(n, 1)) - self.rate * score, -700, 700)))

    def evidence(self, n: int, runs: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Bits of the best run, and of all passages together, on a log scale."""
        bits = [-np.log(self.expected(n, s)) for _, _, s in runs]
        best = float(np.clip(max(bits), -5.0, 50.0)) if bits else -5.0
        passages = sum(b for b in bits if b >= -np.log(self.expect))
        return best, float(np.log1p(max(passages, 0.0)))

    def score(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * evidence[0] + c * evidence[1], -35, 35))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps for a ridge logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    column: str = "toxic",
    without: Column | None = None,
    rows: int = 32_768,
    mass: float = 10.0,
    drift: float = 0.5,
    expect: float = 0.05,
    seed: int = 3,
) -> Toxicity | None:
    """The model from at most ``rows`` labelled documents, None if there are none.

    Three of four sampled documents are counted, the fourth calibrates. Counts come to
    the driver as at most 2^19 places, calibration as the scores of each document's runs.
    """
    none = F.lit(False) if without is None else without
    sample = labelled_sample(labels, column, none, rows, seed)
    texts = sampled_texts(docs, sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, known = np.zeros((2, PLACES), np.int64), _Units()
        n = [0, 0]
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                own = {u for w in set(words_of(text)) for u in known[w]}
                seen[int(label > 0)][np.fromiter(own, np.int64, len(own))] += 1
                n[int(label > 0)] += 1
        at = np.flatnonzero(seen.any(0))
        yield pd.DataFrame(
            {"place": np.append(at, -1), "clean": np.append(seen[0][at], n[0]), "toxic": np.append(seen[1][at], n[1])}
        )

    counted = texts.filter(F.col("draw") % 4 != 0).mapInPandas(count, "place long, clean long, toxic long")
    sums = counted.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    of = sums[sums["place"] == -1]
    n_clean, n_toxic = (int(of["clean"].sum()), int(of["toxic"].sum()))
    if not n_clean + n_toxic:
        return None
    toxic, clean = np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32)
    own = sums[sums["place"] >= 0]
    toxic[own["place"].to_numpy()], clean[own["place"].to_numpy()] = own["toxic"], own["clean"]
    base = (n_toxic + 0.5) / (n_clean + n_toxic + 1.0)
    model = Toxicity(toxic, clean, base, mass, drift, expect=expect)
    # Plain arrays and numbers: executors need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Toxicity(**shared.value)
        scorer = m.scorer()
        for batch in batches:
            made = [m.runs(t, scorer) for t in batch["text"]]
            runs = [[s for _, _, s in r] for _, r in made]
            yield pd.DataFrame({"label": batch["label"].to_numpy(), "n": [n for n, _ in made], "runs": runs})

    tried = texts.filter(F.col("draw") % 4 == 0).mapInPandas(best, "label int, n long, runs array<double>").toPandas()
    return _calibrated(model, tried)


def _calibrated(model: Toxicity, tried: pd.DataFrame) -> Toxicity:
    """Fit the extreme-value law on clean texts and the curve on all."""
    tried = tried[tried["n"] > 0]
    runs = [[(0, 0, float(s)) for s in r] for r in tried["runs"]]
    best = np.array([max((s for _, _, s in r), default=0.0) for r in runs])
    n, toxic = tried["n"].to_numpy(float), tried["label"].to_numpy() > 0
    rate, log_k = 1.0, 0.0
    if (~toxic).sum() >= 20:
        # Two quantiles of the law, so that a few wrong labels do not stretch it: their
        # distance gives lambda, the median K; the length shifts both.
        for _ in range(20):
            middle, high = np.quantile(best[~toxic] - np.log(n[~toxic]) / rate, [0.5, 0.9])
            gap = np.log(np.log(2)) - np.log(-np.log(0.9))
            rate = float(np.clip(gap / max(high - middle, 0.05), 0.2, 10.0))
        log_k = float(np.median(rate * best[~toxic] - np.log(n[~toxic])) + np.log(np.log(2)))
    model = replace(model, rate=rate, log_k=log_k)
    curve = (-20.0, 0.0, 0.0)
    if toxic.any():
        x = np.array([model.evidence(int(k), r) for k, r in zip(n, runs, strict=True)])
        curve = _logistic(x, toxic.astype(float))
    return replace(model, curve=curve)


def toxicity_column(docs: DataFrame, model: Toxicity | None, text: str = "text") -> Column:
    """Struct (score, starts, ends, expected) of each whole text: words from ``start`` up to ``end`` make a passage."""
    if model is None:
        empty = F.array()
        return F.struct(
            F.lit(0.0).alias("score"),
            empty.cast("array<int>").alias("starts"),
            empty.cast("array<int>").alias("ends"),
            empty.cast("array<double>").alias("expected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Toxicity(**shared.value)
        scorer = m.scorer()
        for batch in batches:
            made = []
            for t in batch:
                n, runs = m.runs(t or "", scorer)
                passages = [(a, b, e) for a, b, s in runs if (e := m.expected(n, s)) <= m.expect]
                columns = [[p[i] for p in passages] for i in range(3)]
                made.append((m.score(m.evidence(n, runs)), *columns))
            yield pd.DataFrame(made, columns=["score", "starts", "ends", "expected"])

    return judge(F.coalesce(F.col(text), F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with held_out, score, predicted and passages.

    ``passages`` are structs (start, end, expected) of word positions, the text's words
    being its runs of letters and digits. Labels are learned only from ids whose crc32
    modulo 5 is not 0; labels, lang, source and doc_id never enter a score. A null text
    scores like an empty one, which has no evidence; long texts are read whole; repeated
    rows score alike. No documents give no rows, no labels score 0. Input columns named
    like added ones are replaced.
    """
    model = fit_toxicity(docs, labels, without=held_out(5, 0))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "passages", "_toxicity")]
    judged = docs.select(*kept, held_out(5, 0).alias("held_out"), toxicity_column(docs, model).alias("_toxicity"))
    found = F.arrays_zip(
        F.col("_toxicity.starts").alias("start"),
        F.col("_toxicity.ends").alias("end"),
        F.col("_toxicity.expected").alias("expected"),
    )
    return judged.select(
        *kept,
        "held_out",
        F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= least).cast("int").alias("predicted"),
        found.alias("passages"),
    )
