"""Queries that train, score and explain models on the application records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import only_row
from riskflow.operators import boosting, contract, decide, fairness, metrics, model, sampling, trees, views
from riskflow.plans import features, standins
from riskflow.plans.oracle import double, with_views
from riskflow.plans.registry import query, rounded
from riskflow.session import shared_folder

KEY, LABEL = "customer_id", catalog.TARGET
NUMERIC, CODES = catalog.model_inputs()
EVEN = [i / 16 for i in range(1, 16)]
# Rounds of boosting, as published.
ROUNDS = 400


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned application records, stored once per call: models read them many times."""
    path = f"{shared_folder(spark)}/records"
    contract.clean(standins.applications(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, by the hash of the key alone."""
    split = sampling.loose_split(df, KEY, {"test": 0.25}, "train")
    return (
        split.where("cohort = 'train'").drop("cohort"),
        split.where("cohort = 'test'").drop("cohort"),
    )


def fit_logistic(numeric=tuple(NUMERIC), codes=tuple(CODES)):
    def fit(df: DataFrame) -> model.Scorer:
        return model.train(df, LABEL, numeric, codes, model.logistic)

    return fit


def fit_boosted(numeric=tuple(NUMERIC), codes=tuple(CODES), rounds=ROUNDS, **params):
    def fit(df: DataFrame) -> model.Scorer:
        return model.train(df, LABEL, numeric, codes, model.boosted(rounds, **params))

    return fit


_SCALED = ["limit_bal", "age", "bill_amt1", "pay_amt1"]
_STATS = ", ".join(
    f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _SCALED
)
_STD = ", ".join(f"ROUND((c.{c} - t.m_{c}) / t.s_{c}, 6) AS std_{c}" for c in _SCALED)


@query(
    "standardise",
    with_views(
        f"SELECT c.customer_id, {_STD} FROM cleaned c CROSS JOIN t",
        "cleaned",
        t=f"SELECT {_STATS} FROM cleaned",
    ),
)
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    df = contract.clean(standins.applications(spark, sf))
    made = model.fit_encoding(df, _SCALED, []).transformer().transform(df)
    names = [f"std_{c}" for c in _SCALED]
    return rounded(made.select(KEY, *names), *names)


_CODED = ["education", "pay_0"]
_HOT = ", ".join(
    f"CAST(CASE WHEN {c} = (SELECT DISTINCT NTH_VALUE({c}, {i + 1}) OVER (ORDER BY {c} "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) "
    f"FROM (SELECT DISTINCT {c} FROM cleaned)) THEN 1 ELSE 0 END AS DOUBLE) AS is_{c}_{i}"
    for c, n in (("education", 4), ("pay_0", 5))
    for i in range(1, n)
)


@query("one_hot", with_views(f"SELECT customer_id, {_HOT} FROM cleaned", "cleaned"))
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The first code is the baseline and has no column."""
    df = contract.clean(standins.applications(spark, sf))
    encoding = model.fit_encoding(df, [], _CODED)
    made = encoding.transformer().transform(df)
    return made.select(KEY, *[name for name, _, _ in encoding.columns()])


@query("train_lr")
def train_lr(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of the logistic model."""
    train, _ = parts(records(spark, sf))
    scorer = fit_logistic()(train)
    return _weights(spark, scorer, scorer.model.coefficients.toArray(), "coefficient")


@query("train_gbt")
def train_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """How often each column splits in the boosted model, and the hessian that its splits divide."""
    train, _ = parts(records(spark, sf))
    return second_order(train).gains(spark)


def second_order(train: DataFrame) -> boosting.BoostedTrees:
    """The hand-picked boosted model on a bounded sample of the training rows."""
    return boosting.fit(boosting.draw_sample(train, KEY, LABEL, [*NUMERIC, *CODES]))


def _weights(spark: SparkSession, scorer: model.Scorer, values, name: str) -> DataFrame:
    """A row per encoded column."""
    rows = [
        (column, source, float(v))
        for (column, source, _), v in zip(scorer.encoding.columns(), values, strict=True)
    ]
    return spark.createDataFrame(rows, f"encoded string, source string, {name} double")


@query("candidate_compare")
def candidate_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Both candidates on the test rows, and which is best."""
    train, test = parts(records(spark, sf))
    scored = None
    for name, fit in {"logistic": fit_logistic(), "boosted": second_order}.items():
        part = fit(train).score(test).select(F.lit(name).alias("candidate"), LABEL, "probability")
        scored = part if scored is None else scored.unionByName(part)
    made = metrics.ranking(scored, LABEL, "probability", by=["candidate"], bounds=EVEN)
    top = made.agg(F.max("pr_auc")).scalar()
    return made.select(
        "candidate",
        "rows",
        "pr_auc",
        "roc_auc",
        "brier",
        "log_loss",
        (F.col("pr_auc") == top).alias("best"),
    )


@query("oof_threshold")
def oof_threshold(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = parts(records(spark, sf))
    oof = model.out_of_fold(model.stored_folds(train, KEY, LABEL), fit_logistic())
    return model.tuned_cutoff(oof, LABEL)


TRIALS, SEARCH_FOLDS, BATCH = 30, 3, 10


@query("param_search")
def param_search(spark: SparkSession, sf: str) -> DataFrame:
    """The hand-picked parameters against 30 proposed sets of all eight, by out-of-fold average precision.

    Sets are proposed ten at a time; all fits of a batch run side by side.
    """
    train, _ = parts(records(spark, sf))
    folded = sampling.kfold(train, KEY, LABEL, SEARCH_FOLDS)
    sample = boosting.draw_sample(folded, KEY, LABEL, [*NUMERIC, *CODES], fold="fold")
    tried = {"hand_picked": boosting.Params()}
    means = _cv(spark, sample, tried)
    params, found = dict(tried), means
    for i in range(0, TRIALS, BATCH):
        seen = [(params[r["candidate"]], r["cv_pr_auc"]) for r in found.collect() if r["cv_pr_auc"] is not None]
        proposed = boosting.propose(seen, min(BATCH, TRIALS - i), i)
        batch = {f"trial{i + j}": p for j, p in enumerate(proposed)}
        params |= batch
        found = found.unionByName(_cv(spark, sample, batch))
    base = found.where("candidate = 'hand_picked'").select("cv_pr_auc").scalar()
    best = decide.best_candidate(found, "candidate", "cv_pr_auc").select("candidate").scalar()
    rows = [(n, *[float(getattr(p, c)) for c in boosting.SPACE]) for n, p in params.items()]
    known = spark.createDataFrame(rows, "candidate string, " + ", ".join(f"{c} double" for c in boosting.SPACE))
    return found.join(known, "candidate").select(
        "candidate",
        *boosting.SPACE,
        "cv_pr_auc",
        (F.col("cv_pr_auc") - base).alias("improvement"),
        (F.col("candidate") == best).alias("best"),
    )


def _cv(spark: SparkSession, sample: boosting.Sample, trials: dict[str, boosting.Params]) -> DataFrame:
    """Mean average precision over the folds, a row per trial, stored: the fits run once."""
    margins = boosting.cross_fit(spark, sample, trials, SEARCH_FOLDS)
    path = f"{shared_folder(spark)}/margins"
    margins.withColumn("probability", 1 / (1 + F.exp(-F.col("margin")))).write.parquet(path)
    scored = spark.read.parquet(path).withColumnRenamed("trial", "candidate")
    per_fold = metrics.ranking(scored, "label", "probability", by=["candidate", "fold"], bounds=EVEN)
    path = f"{shared_folder(spark)}/means"
    per_fold.groupBy("candidate").agg(F.avg("pr_auc").alias("cv_pr_auc")).write.parquet(path)
    return spark.read.parquet(path)


@query("score_batch")
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Train, tune the cutoff, save, load, and score with the cutoff that was saved."""
    train, test = parts(records(spark, sf))
    fit = fit_logistic()
    oof = model.out_of_fold(model.stored_folds(train, KEY, LABEL), fit)
    cutoff = model.tuned_cutoff(oof, LABEL).first()["threshold"]
    scorer = fit(train)
    inputs = train.select(*NUMERIC, *CODES).schema
    path = f"{shared_folder(spark)}/scorer"
    model.Scorer(scorer.pipeline, scorer.encoding, cutoff).save(spark, path, inputs)
    loaded, schema = model.load_scorer(spark, path)
    model.check_schema(test, schema)
    return loaded.decide(test).select(KEY, "probability", "prediction")


# Fixed linear weights, so that SQL can repeat the reasons: weight and mean per column.
LINEAR = {
    "limit_bal": (-0.000002, 450000.0),
    "pay_0": (0.5, 0.0),
    "pay_2": (0.2, 0.0),
    "bill_amt1": (0.0000000213579, 20000000.0),
    "pay_amt1": (-0.0000000531357, 10000000.0),
    "education": (0.1, 3.0),
    "age": (0.01, 60.0),
}
_C = {c: f"{double(w)} * ({c} - {double(m)})" for c, (w, m) in LINEAR.items()}
_RANKED = " UNION ALL ".join(
    f"""SELECT customer_id, declined, '{c}' AS feature, CAST({c} AS DOUBLE) AS value,
          {text} AS amount FROM d"""
    for c, text in _C.items()
)
_TEXTS = " ".join(
    f"WHEN '{c}' THEN '{catalog.DESCRIPTIONS[c]}'" for c in LINEAR if c in catalog.DESCRIPTIONS
)


@query(
    "reason_codes",
    with_views(
        f"""SELECT customer_id, declined, place, feature,
              CASE feature {_TEXTS} ELSE feature END AS description, value,
              ROUND(amount, 5) AS contribution,
              CASE WHEN amount > 0 THEN 'increased_risk' ELSE 'decreased_risk' END AS direction
            FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY
                    CASE WHEN declined THEN -amount ELSE -ABS(amount) END, feature) AS INT) AS place
                  FROM r WHERE NOT declined OR amount > 0)
            WHERE place <= 4""",
        "cleaned",
        d=f"SELECT *, ({' + '.join(_C.values())}) > 0.4::DOUBLE AS declined FROM cleaned",
        r=_RANKED,
    ),
)
def reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    df = contract.clean(standins.applications(spark, sf))
    amounts = {c: F.lit(w) * (F.col(c) - F.lit(m)) for c, (w, m) in LINEAR.items()}
    rows = [model.contribution(c, F.col(c), a) for c, a in amounts.items()]
    margin = sum(list(amounts.values())[1:], list(amounts.values())[0])
    made = df.select(
        KEY, F.array(*rows).alias("contributions"), (margin > 0.4).alias("declined")
    )
    told = model.reasons(made, "contributions", F.col("declined"))
    listed = told.select(KEY, "declined", F.posexplode("reasons").alias("place", "r"))
    return listed.select(KEY, "declined", (F.col("place") + 1).alias("place"), "r.*")


@query(
    "reason_additivity",
    with_views("SELECT COUNT(*) AS rows, COUNT(*) AS additive FROM applications", "applications"),
)
def reason_additivity(spark: SparkSession, sf: str) -> DataFrame:
    """Base and contributions of the tree model add up to its log-odds on every row."""
    rows = records(spark, sf)
    explained = trees.tree_contributions(fit_boosted()(parts(rows)[0]), rows, [KEY])
    total = F.aggregate(
        "contributions", F.col("base"), lambda a, r: a + r.contribution
    )
    same = F.abs(total - F.col("margin")) < 1e-6
    return explained.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(same, 1)).alias("additive")
    )


@query("ablation_compare")
def ablation_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The same model with and without the protected columns: ranking and group gaps."""
    train, test = parts(records(spark, sf))
    found = None
    for variant, protected in {"with_protected": True, "without": False}.items():
        numeric, codes = catalog.model_inputs(() if protected else catalog.PROTECTED)
        scored = fit_logistic(numeric, codes)(train).decide(test)
        rank = only_row(metrics.ranking(scored, LABEL, "probability", bounds=EVEN))
        audited = fairness.audit(
            scored, LABEL, "prediction", catalog.AUDITED, {"age": catalog.AGE_EDGES}
        )
        part = fairness.gaps(audited).select(
            F.lit(variant).alias("variant"),
            F.lit(len(numeric) + len(codes)).alias("features"),
            rank["pr_auc"].alias("pr_auc"),
            rank["roc_auc"].alias("roc_auc"),
            "attribute",
            "selection_rate_gap",
            "equal_opportunity_gap",
            "base_rate_gap",
        )
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "counterfactual_invariance",
    with_views(
        "SELECT COUNT(*) AS keys, CAST(0 AS BIGINT) AS changed FROM applications",
        "applications",
    ),
)
def counterfactual_invariance(spark: SparkSession, sf: str) -> DataFrame:
    """The score of a record does not change with its sex: the model never saw it."""
    rows = records(spark, sf)
    variants = model.counterfactuals(rows, "sex", [1, 2])
    return model.invariance(fit_logistic()(parts(rows)[0]).score(variants), KEY)


@query("leak_report")
def leak_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per month: the precision a leaky model reports, what it gets in production, and
    the honest one.

    The join that ignores time gives every month the same rows, so one month of it is
    stored, and one leaky model is fitted and reported for all.
    """
    apps = records(spark, sf)
    names = [*views.EVENT_FEATURES, "limit_bal", "utilisation_latest"]
    label = apps.select(KEY, LABEL)
    root = shared_folder(spark)
    right, wrong = features.both_joins(apps)
    # Stored: every month is read for a fit and for its scores.
    right.join(label, KEY).write.partitionBy("as_of").parquet(f"{root}/honest")
    wrong.where(F.col("as_of") == F.lit(catalog.MONTHS[0])).join(label, KEY).write.parquet(f"{root}/leaked")
    train, test = parts(spark.read.parquet(f"{root}/leaked"))
    fit = fit_logistic(names, [])
    leaked = fit(train)
    reported = metrics.ranking(leaked.score(test), LABEL, "probability", bounds=EVEN).where("rows > 0")
    months = F.explode(F.array(*[F.lit(m) for m in catalog.MONTHS])).alias("as_of")
    reported = reported.select(months, F.col("pr_auc").alias("leaked_reported"))
    scored = None
    for month in catalog.MONTHS:
        train, test = parts(spark.read.parquet(f"{root}/honest").where(F.col("as_of") == F.lit(month)))
        both = fit(train).score(leaked.score(test, "leaked_in_production"), "honest")
        part = both.select(F.lit(month).alias("as_of"), LABEL, "leaked_in_production", "honest")
        scored = part if scored is None else scored.unionByName(part)
    variants = ["leaked_in_production", "honest"]
    scored = scored.unpivot(["as_of", LABEL], variants, "variant", "probability")
    made = metrics.ranking(scored, LABEL, "probability", by=["as_of", "variant"], bounds=EVEN)
    made = made.groupBy("as_of").pivot("variant", variants).agg(F.first("pr_auc"))
    return reported.join(made, "as_of", "left")
