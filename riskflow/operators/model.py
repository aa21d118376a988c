"""Training, scoring and explaining on ``pyspark.ml``.

Preprocessing is part of the fitted pipeline, so the saved artifact scores a raw
frame by itself. Its fitted numbers are literals of one projection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import catalog
from riskflow.functions.scalar import count_where
from riskflow.operators import decide, metrics, sampling
from riskflow.session import shared_folder

# A column with more codes than this is not a category: its codes are learned by the driver.
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Encoding:
    """What preprocessing learned: means and deviations, and the codes of each category."""

    numeric: Mapping[str, tuple[float, float]]
    levels: Mapping[str, Sequence]
    rows: int = 0

    def columns(self) -> list[tuple[str, str, str]]:
        """(encoded column, source column, SQL) in the order of the feature vector."""
        made = [
            (f"std_{c}", c, f"(CAST(`{c}` AS DOUBLE) - CAST('{m!r}' AS DOUBLE)) / CAST('{s!r}' AS DOUBLE)")
            for c, (m, s) in self.numeric.items()
        ]
        for c, values in self.levels.items():
            for i, v in enumerate(values[1:], 1):  # the first code is the baseline
                literal = f"'{v}'" if isinstance(v, str) else repr(v)
                # An unknown code or a null matches none and is all zeros.
                made.append((f"is_{c}_{i}", c, f"CAST(`{c}` <=> {literal} AS DOUBLE)"))
        return made

    def transformer(self) -> SQLTransformer:
        parts = ", ".join(f"{sql} AS `{name}`" for name, _, sql in self.columns())
        return SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__")

    def sources(self) -> list[str]:
        return [source for _, source, _ in self.columns()]


def fit_encoding(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    max_levels: int = MAX_LEVELS,
) -> Encoding:
    """Learn the encoding in passes that return one row, or one per category.

    Deviations are those of the population; a constant column is left unscaled. The
    codes are counted first, exactly and in shuffled groups, so that no task gathers an
    open-ended set; a column with more than ``max_levels`` is refused.
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).cast("double").alias(f"m_{c}") for c in numeric],
        *[F.stddev_pop(c).cast("double").alias(f"s_{c}") for c in numeric],
    ).first()
    scaled = {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in numeric}
    if not categorical:
        return Encoding(scaled, {}, stats["rows"])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("code")) for c in categorical]
    met = df.select(F.inline(F.array(*pairs))).where("code is not null").distinct()
    levels = met.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    if wide := sorted(r["column"] for r in levels.where(F.col("n") > max_levels).collect()):
        raise ValueError(f"too many codes for a category: {wide}")
    codes = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in categorical]).first()
    return Encoding(scaled, {c: list(codes[c]) for c in categorical}, stats["rows"])


def logistic(rows: int, max_iter: int = 1000, c: float = 1.0, tol: float = 1e-4) -> Estimator:
    """Ridge-penalised logistic regression; ``c`` is the inverse strength for the whole sample."""
    return LogisticRegression(
        maxIter=max_iter,
        tol=tol,
        regParam=1.0 / (c * max(rows, 1)),
        elasticNetParam=0.0,
        standardization=False,
    )


def boosted(rounds: int = 400, depth: int = 4, step: float = 0.05, **params) -> Estimator:
    """Boosted trees."""
    # The hand-picked start of the search.
    chosen = {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": catalog.SEED}
    chosen.update(params)
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, **chosen)


@dataclass(frozen=True)
class Scorer:
    """A fitted pipeline with its own cutoff."""

    pipeline: PipelineModel
    encoding: Encoding
    cutoff: float = catalog.DEFAULT_CUTOFF

    @property
    def model(self):
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Add the probability; the columns of the frame stay as they are."""
        made = self.pipeline.transform(df)
        return made.select(*df.columns, vector_to_array("_probability")[1].alias(name))

    def decide(self, df: DataFrame) -> DataFrame:
        """Score, then apply the cutoff that was tuned for this model."""
        scored = self.score(df)
        return scored.withColumn("prediction", (F.col("probability") >= self.cutoff).cast("int"))

    def save(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        """One folder: the pipeline, and its cutoff, codes and input schema beside it."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        note = json.dumps(
            {
                "cutoff": self.cutoff,
                "numeric": {c: list(v) for c, v in self.encoding.numeric.items()},
                "levels": {c: list(v) for c, v in self.encoding.levels.items()},
                "schema": schema.jsonValue(),
            }
        )
        one = spark.createDataFrame([(note,)], "note string").coalesce(1)
        one.write.mode("overwrite").text(f"{path}/note")


def load_scorer(spark: SparkSession, path: str) -> tuple[Scorer, T.StructType]:
    """A saved scorer and the schema its input must have."""
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    encoding = Encoding(
        {c: tuple(v) for c, v in note["numeric"].items()}, note["levels"]
    )
    scorer = Scorer(PipelineModel.load(f"{path}/pipeline"), encoding, note["cutoff"])
    return scorer, T.StructType.fromJson(note["schema"])


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """Fail if a column of the training input is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {wrong}")


def train(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    estimator: Estimator | Callable[[int], Estimator],
) -> Scorer:
    """Fit preprocessing and estimator as one artifact.

    The estimator may be a function of the number of rows, which preprocessing counts.
    """
    encoding = fit_encoding(df, numeric, categorical)
    if not isinstance(estimator, Estimator):
        estimator = estimator(encoding.rows)
    prepare = encoding.transformer()
    assemble = VectorAssembler(
        inputCols=[name for name, _, _ in encoding.columns()],
        outputCol="_features",
        handleInvalid="error",
    )
    estimator = estimator.copy(
        {
            estimator.getParam("featuresCol"): "_features",
            estimator.getParam("labelCol"): label,
            estimator.getParam("rawPredictionCol"): "_raw",
            estimator.getParam("probabilityCol"): "_probability",
            estimator.getParam("predictionCol"): "_prediction",
        }
    )
    fitted = estimator.fit(assemble.transform(prepare.transform(df)))
    return Scorer(PipelineModel(stages=[prepare, assemble, fitted]), encoding)


def stored_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = catalog.SEED
) -> DataFrame:
    """The frame with its folds, as a table in the shared folder with one folder per fold:
    each fit reads only the folds it trains on, and nothing before the split runs twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folds"
    sampling.kfold(df, key, label, k, seed).write.partitionBy("fold").parquet(path)
    return spark.read.parquet(path)


def out_of_fold(folded: DataFrame, fit: Callable[[DataFrame], Scorer], k: int = 5) -> DataFrame:
    """Every row scored by a model that did not see it."""
    parts = [
        fit(folded.where(F.col("fold") != i)).score(folded.where(F.col("fold") == i))
        for i in range(k)
    ]
    return reduce(DataFrame.unionByName, parts)


def tuned_cutoff(oof: DataFrame, label: str) -> DataFrame:
    """The cheapest cutoff on out-of-fold scores, so the test rows stay unseen."""
    return decide.threshold_choice(decide.threshold_curve(oof, label, "probability"))


def search(
    df: DataFrame,
    key: str,
    label: str,
    candidates: Mapping[str, Callable[[DataFrame], Scorer]],
    baseline: str,
    k: int = 3,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Mean cross-validated average precision of each candidate, its lead over the
    baseline, and which is best. All folds of all candidates are judged in one job."""
    folded = stored_folds(df, key, label, k)
    parts = [
        out_of_fold(folded, fit, k).select(
            F.lit(name).alias("candidate"), "fold", label, "probability"
        )
        for name, fit in candidates.items()
    ]
    scored = reduce(DataFrame.unionByName, parts)
    if bounds is None:
        bounds = [i / 16 for i in range(1, 16)]
    per_fold = metrics.ranking(
        scored, label, "probability", by=["candidate", "fold"], bounds=bounds
    )
    means = per_fold.groupBy("candidate").agg(F.avg("pr_auc").alias("cv_pr_auc"))
    base = means.where(F.col("candidate") == baseline).select("cv_pr_auc").scalar()
    best = decide.best_candidate(means, "candidate", "cv_pr_auc").select("candidate").scalar()
    return means.select(
        "candidate",
        "cv_pr_auc",
        (F.col("cv_pr_auc") - base).alias("improvement"),
        (F.col("candidate") == best).alias("best"),
    )


def contribution(feature: str, value: Column, amount: Column) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        value.cast("double").alias("value"),
        amount.cast("double").alias("contribution"),
    )


def linear_contributions(
    scorer: Scorer, background: Mapping[str, float], name: str = "contributions"
) -> Callable[[DataFrame], DataFrame]:
    """What each source column adds to the log-odds, against the mean row.

    ``background`` holds the mean of every encoded column. Encoded columns count for
    the column they came from. Plain expressions, no Python.
    """
    weights = scorer.model.coefficients.toArray()
    terms: dict[str, list[Column]] = {}
    for (encoded, source, sql), w in zip(scorer.encoding.columns(), weights, strict=True):
        term = F.lit(float(w)) * (F.expr(sql) - F.lit(float(background[encoded])))
        terms.setdefault(source, []).append(term)
    rows = [contribution(s, F.col(s), sum(t[1:], t[0])) for s, t in terms.items()]
    return lambda df: df.withColumn(name, F.array(*rows))


def encoded_means(scorer: Scorer, df: DataFrame) -> dict[str, float]:
    """Mean of every encoded column: one row."""
    row = df.agg(*[F.avg(F.expr(sql)).alias(n) for n, _, sql in scorer.encoding.columns()]).first()
    return row.asDict()


def reasons(
    df: DataFrame,
    contributions: str,
    declined: Column,
    k: int = catalog.TOP_REASONS,
    descriptions: Mapping[str, str] | None = None,
    name: str = "reasons",
) -> DataFrame:
    """The k principal reasons of each decision.

    For a declined row only what raised the risk, highest first; for an approved row
    the strongest either way.
    """
    texts = descriptions if descriptions is not None else catalog.DESCRIPTIONS
    lookup = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])

    def by_strength(rows: Column, strength: Callable[[Column], Column]) -> Column:
        keyed = F.transform(
            rows, lambda r: F.struct((-strength(r)).alias("_o"), r.feature.alias("_f"), r.alias("_r"))
        )
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda r: r["_r"])

    rows = F.col(contributions)
    raised = by_strength(
        F.filter(rows, lambda r: r.contribution > 0), lambda r: r.contribution
    )
    strongest = by_strength(rows, lambda r: F.abs(r.contribution))
    told = F.transform(
        F.when(declined, raised).otherwise(strongest),
        lambda r: F.struct(
            r.feature.alias("feature"),
            F.coalesce(F.element_at(lookup, r.feature), r.feature).alias("description"),
            r.value.alias("value"),
            F.round(r.contribution, 5).alias("contribution"),
            F.when(r.contribution > 0, "increased_risk")
            .otherwise("decreased_risk")
            .alias("direction"),
        ),
    )
    return df.withColumn(name, told)


def counterfactuals(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Each row once per value of a column, everything else as it was."""
    others = F.explode(F.array(*[F.lit(v) for v in values])).alias("_v")
    return df.select("*", others).withColumn(column, F.col("_v")).drop("_v")


def invariance(scored: DataFrame, key: str, score: str = "probability") -> DataFrame:
    """How many keys got more than one score over their variants."""
    spread = scored.groupBy(key).agg((F.max(score) - F.min(score)).alias("_gap"))
    return spread.agg(
        F.count(F.lit(1)).alias("keys"), count_where(F.col("_gap") > 0).alias("changed")
    )
