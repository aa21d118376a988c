"""Queries on metrics, decisions and fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import hash_uniform
from riskflow.operators import decide, fairness, metrics, sampling
from riskflow.plans import standins
from riskflow.plans.oracle import (
    BRIER,
    EFFECTIVE_ROWS,
    POSITIVE_RATE,
    PR_AUC,
    ROC_AUC,
    double,
    ranking_steps,
    uniform,
    with_views,
)
from riskflow.plans.outcomes import score_bounds
from riskflow.plans.registry import query, rounded

_PLAIN = "SELECT probability AS p, label AS y FROM labelled"
_WEIGHED = "SELECT probability AS p, label AS y, weight FROM weighed"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return standins.labelled(spark, sf).select(
        "application_id", "customer_id", "probability", "prediction", "label"
    )


def observed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows whose outcome could be seen: approved ones and the holdout."""
    rows = sampling.observe(labelled(spark, sf), "application_id")
    return rows.where("observable").drop("observable", "holdout")


def ranked(spark: SparkSession, sf: str, rows: DataFrame, **options) -> DataFrame:
    return metrics.ranking(
        rows, "label", "probability", bounds=score_bounds(spark, sf), **options
    )


def _one(metric: str, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(ranked(spark, sf, labelled(spark, sf)).select(metric), metric)

    text = f"SELECT ROUND({sql}, 6) AS {metric} FROM c"
    return run, with_views(text, "labelled", **ranking_steps(_PLAIN))


def _weighted(metric: str, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = metrics.with_weights(observed_rows(spark, sf))
        return rounded(ranked(spark, sf, rows, weight="weight").select(metric), metric)

    text = f"SELECT ROUND({sql}, 6) AS {metric} FROM c"
    return run, with_views(text, "weighed", **ranking_steps(_WEIGHED, "weight"))


_LOG_LOSS = f"""-SUM(tp * LN(LEAST(GREATEST(p, {double(metrics.EPSILON)}), {double(1 - metrics.EPSILON)}))
  + fp * LN(1 - LEAST(GREATEST(p, {double(metrics.EPSILON)}), {double(1 - metrics.EPSILON)})))
  / SUM(tp + fp)"""

for _name, (_run, _sql) in {
    "pr_auc": _one("pr_auc", PR_AUC),
    "roc_auc": _one("roc_auc", ROC_AUC),
    "brier": _one("brier", BRIER),
    "log_loss": _one("log_loss", _LOG_LOSS),
    "pr_auc_weighted": _weighted("pr_auc", PR_AUC),
    "roc_auc_weighted": _weighted("roc_auc", ROC_AUC),
}.items():
    query(_name, _sql)(_run)


@query(
    "pr_curve",
    with_views(
        """SELECT p AS threshold, ROUND(ctp / (ctp + cfp), 6) AS precision,
             ROUND(ctp / atp, 6) AS recall FROM c""",
        "labelled",
        **ranking_steps(_PLAIN),
    ),
)
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = metrics.pr_curve(
        labelled(spark, sf), "label", "probability", bounds=score_bounds(spark, sf)
    )
    return rounded(curve, "precision", "recall")


_EDGES = ", ".join(f"quantile_cont(p, {i / 10}) AS e{i}" for i in range(1, 10))
_BIN = " + ".join(f"CASE WHEN p > e{i} THEN 1 ELSE 0 END" for i in range(1, 10))


@query(
    "calibration",
    with_views(
        f"""SELECT bin, COUNT(*) AS rows, ROUND(AVG(p), 6) AS mean_predicted,
              CAST(SUM(y) AS DOUBLE) / COUNT(*) AS observed_frequency
            FROM (SELECT p, y, {_BIN} AS bin FROM r CROSS JOIN e) GROUP BY bin""",
        "labelled",
        r=_PLAIN,
        e=f"SELECT {_EDGES} FROM r",
    ),
)
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    made = metrics.calibration(
        labelled(spark, sf), "label", "probability", bounds=score_bounds(spark, sf)
    )
    return rounded(made, "mean_predicted")


@query(
    "confusion",
    with_views(
        """SELECT *, CASE WHEN 2 * true_positives + false_positives + false_negatives > 0
             THEN CAST(2 * true_positives AS DOUBLE)
                  / (2 * true_positives + false_positives + false_negatives) ELSE 0 END AS f1
           FROM (SELECT COUNT(*) FILTER (WHERE probability < 0.58::DOUBLE AND label = 0) AS true_negatives,
                   COUNT(*) FILTER (WHERE probability >= 0.58::DOUBLE AND label = 0) AS false_positives,
                   COUNT(*) FILTER (WHERE probability < 0.58::DOUBLE AND label = 1) AS false_negatives,
                   COUNT(*) FILTER (WHERE probability >= 0.58::DOUBLE AND label = 1) AS true_positives
                 FROM labelled)""",
        "labelled",
    ),
)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(labelled(spark, sf), "label", "probability", 0.58)


@query(
    "expected_cost",
    with_views(
        """SELECT CAST(5 * COUNT(*) FILTER (WHERE probability < 0.17::DOUBLE AND label = 1)
             + COUNT(*) FILTER (WHERE probability >= 0.17::DOUBLE AND label = 0) AS DOUBLE) / COUNT(*)
             AS expected_cost FROM labelled""",
        "labelled",
    ),
)
def expected_cost(spark: SparkSession, sf: str) -> DataFrame:
    return decide.expected_cost(labelled(spark, sf), "label", "probability", 0.17)


_GRID = f"SELECT unnest([{', '.join(double(t) for t in catalog.CUTOFFS)}]) AS t"
_CURVE = """SELECT t AS threshold,
    CAST(5 * SUM(CASE WHEN p < t AND y = 1 THEN n ELSE 0 END)
         + SUM(CASE WHEN p >= t AND y = 0 THEN n ELSE 0 END) AS DOUBLE) / SUM(n) AS cost,
    CAST(SUM(CASE WHEN p >= t THEN n ELSE 0 END) AS DOUBLE) / SUM(n) AS decline_rate
  FROM (SELECT probability AS p, label AS y, COUNT(*) AS n FROM labelled GROUP BY 1, 2)
  CROSS JOIN grid GROUP BY t"""


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return decide.threshold_curve(labelled(spark, sf), "label", "probability")


@query(
    "threshold_curve",
    with_views("SELECT * FROM k", "labelled", grid=_GRID, k=_CURVE),
)
def threshold_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curve(spark, sf)


@query(
    "threshold_choice",
    with_views(
        """SELECT b.threshold, b.cost AS expected_cost, h.cost AS cost_at_half,
             h.cost - b.cost AS cost_reduction, b.decline_rate
           FROM (SELECT * FROM k ORDER BY cost, threshold LIMIT 1) b
           CROSS JOIN (SELECT cost FROM k WHERE threshold = 0.5::DOUBLE) h""",
        "labelled",
        grid=_GRID,
        k=_CURVE,
    ),
)
def threshold_choice(spark: SparkSession, sf: str) -> DataFrame:
    return decide.threshold_choice(curve(spark, sf))


@query(
    "ipw_weights",
    with_views(
        f"""SELECT application_id, CASE WHEN prediction = 1 THEN {double(0.02)} ELSE 1 END
              AS selection_probability, weight FROM weighed""",
        "weighed",
    ),
)
def ipw_weights(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_weights(observed_rows(spark, sf)).select(
        "application_id", "selection_probability", "weight"
    )


_ESTIMATE = f"""CAST(SUM(n) AS BIGINT) AS rows, ROUND({EFFECTIVE_ROWS}, 4) AS effective_rows,
    ROUND({POSITIVE_RATE}, 6) AS positive_rate, ROUND({PR_AUC}, 6) AS pr_auc,
    ROUND({ROC_AUC}, 6) AS roc_auc, ROUND({BRIER}, 6) AS brier"""
_THREE = """SELECT 'observed' AS estimate, probability AS p, label AS y, 1.0::DOUBLE AS weight
    FROM weighed WHERE prediction = 0
  UNION ALL SELECT 'ipw', probability, label, weight FROM weighed
  UNION ALL SELECT 'full', probability, label, 1.0 FROM labelled"""


@query(
    "performance_compare",
    with_views(
        f"SELECT estimate, {_ESTIMATE} FROM c GROUP BY estimate",
        "weighed",
        **ranking_steps(_THREE, "weight", "estimate"),
    ),
)
def performance_compare(spark: SparkSession, sf: str) -> DataFrame:
    made = metrics.compare_estimates(
        observed_rows(spark, sf), truth=labelled(spark, sf), bounds=score_bounds(spark, sf)
    )
    made = rounded(made, "effective_rows", places=4)
    return rounded(made, "positive_rate", "pr_auc", "roc_auc", "brier")


@query(
    "estimate_full",
    with_views(f"SELECT {_ESTIMATE} FROM c", "labelled", **ranking_steps(_PLAIN)),
)
def estimate_full(spark: SparkSession, sf: str) -> DataFrame:
    """The answer key: every decision joined to its outcome, declined ones included."""
    made = ranked(spark, sf, labelled(spark, sf)).drop("log_loss")
    made = rounded(made, "effective_rows", places=4)
    return rounded(made, "positive_rate", "pr_auc", "roc_auc", "brier")


@query(
    "effective_rows",
    with_views(
        """SELECT COUNT(*) AS rows, ROUND(SUM(weight) * SUM(weight) / SUM(weight * weight), 4)
             AS effective_rows FROM weighed""",
        "weighed",
    ),
)
def effective_rows(spark: SparkSession, sf: str) -> DataFrame:
    weighed = metrics.with_weights(observed_rows(spark, sf))
    return rounded(metrics.effective_rows(weighed), "effective_rows", places=4)


@query(
    "single_class_metrics",
    with_views(
        f"""SELECT label, CAST(SUM(n) AS BIGINT) AS rows, CAST(NULL AS DOUBLE) AS pr_auc,
              CAST(NULL AS DOUBLE) AS roc_auc, ROUND({BRIER}, 6) AS brier FROM c GROUP BY label""",
        "labelled",
        **ranking_steps("SELECT label, probability AS p, label AS y FROM labelled", by="label"),
    ),
)
def single_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Sliced by label, every slice has one class: nothing to rank, still a Brier score."""
    rows = labelled(spark, sf).withColumn("slice", F.col("label"))
    made = ranked(spark, sf, rows, by=["slice"]).withColumnRenamed("slice", "label")
    return rounded(made.select("label", "rows", "pr_auc", "roc_auc", "brier"), "brier")


@query(
    "approved_yardstick",
    with_views(
        f"""SELECT slice, CAST(SUM(n) AS BIGINT) AS rows, ROUND({PR_AUC}, 6) AS pr_auc
            FROM c GROUP BY slice""",
        "labelled",
        **ranking_steps(
            """SELECT 'all' AS slice, probability AS p, label AS y FROM labelled
               UNION ALL SELECT 'approved', probability, label FROM labelled WHERE prediction = 0""",
            by="slice",
        ),
    ),
)
def approved_yardstick(spark: SparkSession, sf: str) -> DataFrame:
    slices = F.when(F.col("prediction") == 0, F.array(F.lit("all"), F.lit("approved"))).otherwise(
        F.array(F.lit("all"))
    )
    rows = labelled(spark, sf).select("probability", "label", F.explode(slices).alias("slice"))
    made = ranked(spark, sf, rows, by=["slice"])
    return rounded(made.select("slice", "rows", "pr_auc"), "pr_auc")


# Two scores for the gate: what was served, and a hash of the key that knows nothing.
_SCORES = f"""SELECT 'challenger' AS alias, probability AS p, label AS y FROM labelled
  UNION ALL SELECT 'champion', {uniform("application_id", 3)}, label FROM labelled"""


def alias_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.inline(
        F.array(
            F.struct(F.lit("challenger").alias("alias"), F.col("probability").alias("score")),
            F.struct(
                F.lit("champion").alias("alias"), hash_uniform("application_id", 3).alias("score")
            ),
        )
    )
    rows = labelled(spark, sf).select("label", "application_id", "probability", scores)
    even = [i / 8 for i in range(1, 8)]
    made = metrics.ranking(rows, "label", "score", by=["alias"], bounds=even)
    return made.select("alias", F.round("pr_auc", 6).alias("pr_auc"))


_ALIASES = f"SELECT alias, ROUND({PR_AUC}, 6) AS pr_auc FROM c GROUP BY alias"
_GATE = """SELECT *, reasons = '' AS passed FROM (
    SELECT challenger, champion, CONCAT_WS(',',
      CASE WHEN challenger IS NULL THEN 'no challenger' END,
      CASE WHEN challenger < {floor} THEN 'below the floor' END,
      CASE WHEN challenger - champion < -0.01::DOUBLE THEN 'worse than the champion' END) AS reasons
    FROM (SELECT MAX(CASE WHEN alias = 'challenger' THEN pr_auc END) AS challenger,
                 MAX(CASE WHEN alias = 'champion' THEN pr_auc END) AS champion FROM a))"""


@query(
    "quality_gate",
    with_views(
        _GATE.format(floor="0.5::DOUBLE"), "labelled", **ranking_steps(_SCORES, by="alias"), a=_ALIASES
    ),
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    judged = decide.quality_gate(alias_metrics(spark, sf))
    return judged.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "best_candidate",
    with_views(
        "SELECT alias AS candidate, pr_auc FROM a ORDER BY pr_auc DESC, alias LIMIT 1",
        "labelled",
        **ranking_steps(_SCORES, by="alias"),
        a=_ALIASES,
    ),
)
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    made = alias_metrics(spark, sf).withColumnRenamed("alias", "candidate")
    return decide.best_candidate(made)


_VERSIONS = """SELECT c.segment AS model, CAST(EXTRACT(year FROM e.statement_month) AS INT) - 1994
    AS version FROM monthly_events e JOIN customers c ON c.customer_id = e.customer_id GROUP BY 1, 2"""


@query(
    "registry_promote",
    with_views(
        """SELECT model, 'challenger' AS alias, MAX(version) AS version FROM v GROUP BY model
           UNION ALL
           SELECT model, 'champion', CASE WHEN (SELECT passed FROM gate) THEN MAX(version)
                                          ELSE MIN(version) END FROM v GROUP BY model""",
        "labelled",
        "monthly_events",
        "customers",
        **ranking_steps(_SCORES, by="alias"),
        a=_ALIASES,
        gate=_GATE.format(floor="0.1::DOUBLE"),
        v=_VERSIONS,
    ),
)
def registry_promote(spark: SparkSession, sf: str) -> DataFrame:
    """A model per segment with a version per year; its champion is the first so far."""
    events = standins.monthly_events(spark, sf).join(standins.customers(spark, sf), "customer_id")
    versions = events.select(
        F.col("segment").alias("model"), (F.year("statement_month") - 1994).alias("version")
    ).distinct()
    aliases = versions.groupBy("model").agg(
        F.min("version").alias("version"), F.lit("champion").alias("alias")
    )
    gate = decide.quality_gate(alias_metrics(spark, sf), floor=0.1)
    return decide.promote(aliases, versions, gate)


_GROUPS = """SELECT l.prediction, l.label, c.segment,
    CASE WHEN c.limit_bal >= 0 AND c.limit_bal < 250000 THEN '0-250000'
         WHEN c.limit_bal >= 250000 AND c.limit_bal < 500000 THEN '250000-500000'
         WHEN c.limit_bal >= 500000 AND c.limit_bal < 2000000 THEN '500000-2000000' END AS limit_bal
  FROM labelled l JOIN customers c ON c.customer_id = l.customer_id"""
LIMIT_EDGES = [0, 250_000, 500_000, 2_000_000]


def _share(top: str, bottom: str) -> str:
    return f"""CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0 END"""


_POS = "COUNT(*) FILTER (WHERE label = 1)"
_NEG = "COUNT(*) FILTER (WHERE label = 0)"
_RATES = f"""COUNT(*) AS n, {_POS} AS n_pos,
    {_share("COUNT(*) FILTER (WHERE prediction = 1)", "COUNT(*)")} AS selection_rate,
    {_share("COUNT(*) FILTER (WHERE prediction = 1 AND label = 1)", _POS)} AS true_positive_rate,
    {_share("COUNT(*) FILTER (WHERE prediction = 1 AND label = 0)", _NEG)} AS false_positive_rate,
    {_share(_POS, "COUNT(*)")} AS base_rate"""
_AUDIT = f"""SELECT 'segment' AS attribute, segment AS "group", {_RATES} FROM groups
    WHERE segment IS NOT NULL GROUP BY segment
  UNION ALL SELECT 'limit_bal', limit_bal, {_RATES} FROM groups
    WHERE limit_bal IS NOT NULL GROUP BY limit_bal"""
_GAPS = """SELECT attribute, COUNT(*) AS groups,
    CASE WHEN COUNT(*) > 1 THEN MAX(selection_rate) - MIN(selection_rate) ELSE 0 END
      AS selection_rate_gap,
    CASE WHEN COUNT(*) > 1 THEN MAX(true_positive_rate) - MIN(true_positive_rate) ELSE 0 END
      AS equal_opportunity_gap,
    CASE WHEN COUNT(*) > 1 THEN MAX(base_rate) - MIN(base_rate) ELSE 0 END AS base_rate_gap
  FROM audited GROUP BY attribute"""


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).join(standins.customers(spark, sf), "customer_id")


def audited(spark: SparkSession, sf: str) -> DataFrame:
    """An attribute the frame lacks is skipped."""
    return fairness.audit(
        groups(spark, sf),
        "label",
        "prediction",
        ["segment", "limit_bal", "region"],
        bands={"limit_bal": LIMIT_EDGES},
    )


@query(
    "fairness_groups",
    with_views(
        f'SELECT segment AS "group", {_RATES} FROM groups GROUP BY segment',
        "labelled",
        "customers",
        groups=_GROUPS,
    ),
)
def fairness_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.group_rates(groups(spark, sf), "segment", "label", "prediction")


@query(
    "fairness_audit",
    with_views(_AUDIT, "labelled", "customers", groups=_GROUPS),
)
def fairness_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audited(spark, sf)


@query(
    "fairness_gaps",
    with_views(
        f"SELECT *, selection_rate_gap <= 0.1::DOUBLE AS within_limit FROM ({_GAPS})",
        "labelled",
        "customers",
        groups=_GROUPS,
        audited=_AUDIT,
    ),
)
def fairness_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.gaps(audited(spark, sf))


@query(
    "fairness_flat",
    with_views(
        f"""SELECT 'fairness_' || attribute || '_selection_gap' AS metric,
              ROUND(selection_rate_gap, 6) AS value FROM ({_GAPS})
            UNION ALL SELECT 'fairness_' || attribute || '_equal_opportunity_gap',
              ROUND(equal_opportunity_gap, 6) FROM ({_GAPS})""",
        "labelled",
        "customers",
        groups=_GROUPS,
        audited=_AUDIT,
    ),
)
def fairness_flat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fairness.flat(fairness.gaps(audited(spark, sf))), "value")


_RATES_GRID = ", ".join(f"({double(r)})" for r in catalog.HOLDOUT_RATES)
_SWEEP_U = uniform("d.draw || ':' || l.application_id")
_SWEEP = f"""SELECT r.rate, d.draw, l.probability AS p, l.label AS y, l.prediction,
    CASE WHEN l.prediction = 1 THEN 1.0::DOUBLE / r.rate ELSE 1.0::DOUBLE END AS weight
  FROM labelled l CROSS JOIN (VALUES {_RATES_GRID}) r(rate)
  CROSS JOIN (SELECT unnest(range(1, 26)) AS draw) d
  WHERE l.prediction = 0 OR {_SWEEP_U} < r.rate"""


@query(
    "holdout_sweep",
    with_views(
        f"""SELECT a.rate AS holdout_rate, COUNT(*) AS draws,
              ROUND(AVG(x.extra), 6) AS mean_extra_approvals,
              ROUND(AVG(a.auc), 6) AS mean_pr_auc_ipw,
              ROUND(STDDEV_SAMP(a.auc), 6) AS std_across_draws,
              ROUND(AVG(a.auc) - (SELECT {PR_AUC} FROM ct), 6) AS mean_error_vs_truth,
              ROUND(AVG((5.0::DOUBLE * x.bad - (x.extra - x.bad))
                        / (SELECT COUNT(*) FROM labelled) * 1000), 6) AS cost_per_1000
            FROM (SELECT rate, draw, {PR_AUC} AS auc FROM c GROUP BY rate, draw) a
            JOIN (SELECT rate, draw, COUNT(*) FILTER (WHERE prediction = 1) AS extra,
                         COUNT(*) FILTER (WHERE prediction = 1 AND y = 1) AS bad
                  FROM sweep GROUP BY rate, draw) x ON x.rate = a.rate AND x.draw = a.draw
            GROUP BY a.rate""",
        "labelled",
        sweep=_SWEEP,
        **ranking_steps("SELECT * FROM sweep", "weight", "rate, draw"),
        gt=ranking_steps(_PLAIN)["g"],
        ct=ranking_steps(_PLAIN)["c"].replace("FROM g", "FROM gt"),
    ),
)
def holdout_sweep(spark: SparkSession, sf: str) -> DataFrame:
    made = metrics.holdout_sweep(
        labelled(spark, sf), "application_id", bounds=score_bounds(spark, sf)
    )
    return rounded(
        made,
        "mean_extra_approvals",
        "mean_pr_auc_ipw",
        "std_across_draws",
        "mean_error_vs_truth",
        "cost_per_1000",
    )


@query("bootstrap_se")
def bootstrap_se(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted estimate, its standard error, and whether the two can be quoted."""
    rows = metrics.with_weights(observed_rows(spark, sf))
    bounds = score_bounds(spark, sf)
    spread = metrics.bootstrap_std_error(rows, "label", "probability", "weight", bounds=bounds)
    estimate = metrics.ranking(rows, "label", "probability", "weight", bounds=bounds)
    return metrics.usable(estimate.select("rows", "effective_rows", "pr_auc"), spread)


@query(
    "bootstrap_totals",
    with_views(
        """SELECT CAST(d.draw AS INT) AS draw, n AS total, TRUE AS both_classes, TRUE AS varies
           FROM (SELECT COUNT(*) AS n FROM observed_rows) CROSS JOIN RANGE(0, 200) d(draw)""",
        "observed_rows",
    ),
)
def bootstrap_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Each of 200 draws has as many rows as the table, of both classes, and not the table's own mix alone."""
    rows = observed_rows(spark, sf)
    made = metrics.bootstrap_totals(rows, "label", "probability", bounds=score_bounds(spark, sf))
    whole = Window.partitionBy(F.col("positives") + F.col("negatives"))  # one row per draw
    varies = F.min("positives").over(whole) < F.max("positives").over(whole)
    return made.select(
        "draw",
        (F.col("positives") + F.col("negatives")).alias("total"),
        ((F.col("positives") > 0) & (F.col("negatives") > 0)).alias("both_classes"),
        varies.alias("varies"),
    )
