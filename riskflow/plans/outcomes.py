"""Queries on late labels and the splits of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions import scalar
from riskflow.functions.scalar import hash_uniform
from riskflow.operators import labels, metrics, sampling
from riskflow.operators.prefix import range_bounds
from riskflow.plans import standins
from riskflow.plans.oracle import (
    POSITIVE_RATE,
    PR_AUC,
    double,
    ranking_steps,
    uniform,
    with_views,
)
from riskflow.plans.registry import query, rounded

AS_OF = "1999-06-01 00:00:00"
_T = f"TIMESTAMP '{AS_OF}'"
_READY = f"predicted_at <= {_T} - INTERVAL 30 DAY"
_KNOWN = f"(SELECT * FROM outcomes WHERE observed_at <= {_T})"


def score_bounds(spark: SparkSession, sf: str) -> list[float]:
    """Ranges of the served score, from its column alone: no join is run for them."""
    return range_bounds(standins.decisions(spark, sf), "probability")


@query(
    "matured_decisions",
    with_views(f"SELECT * FROM decisions WHERE {_READY}", "decisions"),
)
def matured_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return labels.matured(standins.decisions(spark, sf), AS_OF)


@query(
    "label_join",
    with_views(
        f"""SELECT d.*, d.predicted_at + INTERVAL 30 DAY AS matures_at, o.outcome_at, o.observed_at,
              o.label
            FROM decisions d JOIN {_KNOWN} o ON o.application_id = d.application_id WHERE {_READY}""",
        "decisions",
        "outcomes",
    ),
)
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    return labels.join_labels(
        standins.decisions(spark, sf), standins.outcomes(spark, sf), AS_OF
    )


_COUNTS = f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE r) AS matured,
    COUNT(*) FILTER (WHERE r AND s) AS observed,
    COUNT(*) FILTER (WHERE r AND NOT s AND prediction = 0) AS pending,
    COUNT(*) FILTER (WHERE r AND NOT s AND prediction = 1) AS censored
  FROM (SELECT d.prediction, {_READY} AS r, o.application_id IS NOT NULL AS s
        FROM decisions d LEFT JOIN {_KNOWN} o ON o.application_id = d.application_id)"""
_SHARES = """CASE WHEN matured > 0 THEN CAST(observed AS DOUBLE) / matured ELSE 0 END AS coverage,
    CASE WHEN total > 0 THEN CAST(matured AS DOUBLE) / total ELSE 0 END AS maturity"""


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return labels.join_counts(
        standins.decisions(spark, sf), standins.outcomes(spark, sf), AS_OF
    )


@query(
    "label_join_counts",
    with_views(f"SELECT *, {_SHARES} FROM k", "decisions", "outcomes", k=_COUNTS),
)
def label_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf)


@query(
    "coverage_floor",
    with_views(
        f"SELECT *, coverage >= 0.5::DOUBLE AS above_floor FROM (SELECT *, {_SHARES} FROM k)",
        "decisions",
        "outcomes",
        k=_COUNTS,
    ),
)
def coverage_floor(spark: SparkSession, sf: str) -> DataFrame:
    return labels.covered(counts(spark, sf))


@query(
    "label_join_naive",
    with_views(
        """SELECT d.*, o.outcome_at, o.observed_at, o.label
           FROM decisions d JOIN outcomes o ON o.application_id = d.application_id""",
        "decisions",
        "outcomes",
    ),
)
def label_join_naive(spark: SparkSession, sf: str) -> DataFrame:
    return labels.join_ignoring_time(standins.decisions(spark, sf), standins.outcomes(spark, sf))


@query(
    "label_pending_censored",
    with_views(
        f"""SELECT CASE WHEN prediction = 1 THEN 'censored' ELSE 'pending' END AS state,
              COUNT(*) AS n
            FROM decisions d WHERE {_READY} AND NOT EXISTS (
              SELECT 1 FROM {_KNOWN} o WHERE o.application_id = d.application_id) GROUP BY 1""",
        "decisions",
        "outcomes",
    ),
)
def label_pending_censored(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.unlabelled(standins.decisions(spark, sf), standins.outcomes(spark, sf), AS_OF)
    state = F.when(F.col("prediction") == 1, "censored").otherwise("pending")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


_BOTH = f"""SELECT 'ignores_time' AS joined, probability AS p, label AS y FROM labelled
  UNION ALL SELECT 'point_in_time', probability, label FROM labelled
  WHERE {_READY} AND observed_at <= {_T}"""


@query(
    "label_leak_report",
    with_views(
        f"""SELECT joined, CAST(SUM(n) AS BIGINT) AS rows, ROUND({PR_AUC}, 6) AS pr_auc,
              ROUND({POSITIVE_RATE}, 6) AS positive_rate FROM c GROUP BY joined""",
        "labelled",
        **ranking_steps(_BOTH, by="joined"),
    ),
)
def label_leak_report(spark: SparkSession, sf: str) -> DataFrame:
    """Both joins scored from one pass: the correct rows are a subset of the naive ones."""
    naive = labels.join_ignoring_time(standins.decisions(spark, sf), standins.outcomes(spark, sf))
    due = scalar.instant(scalar.days_before(AS_OF, catalog.WINDOW_DAYS))
    honest = (F.col("predicted_at") <= due) & (F.col("observed_at") <= scalar.instant(AS_OF))
    kinds = F.array_compact(
        F.array(F.lit("ignores_time"), F.when(honest, F.lit("point_in_time")))
    )
    rows = naive.select("probability", "label", F.explode(kinds).alias("joined"))
    made = metrics.ranking(
        rows, "label", "probability", by=["joined"], bounds=score_bounds(spark, sf)
    )
    return rounded(
        made.select("joined", "rows", "pr_auc", "positive_rate"), "pr_auc", "positive_rate"
    )


OFFSETS = [*catalog.MATURITY_OFFSETS, 800, 1200, 1600, 2000, 2400]
_DATES = ", ".join(f"({d})" for d in OFFSETS)
_CURVE = f"""SELECT t.days, a.prediction, a.probability, a.label,
    a.predicted_at + INTERVAL 30 DAY <= a.origin + t.days * INTERVAL 1 DAY AS ready,
    COALESCE(a.observed_at <= a.origin + t.days * INTERVAL 1 DAY, FALSE) AS known
  FROM (SELECT d.*, o.observed_at, o.label, MIN(d.predicted_at) OVER () AS origin
        FROM decisions d LEFT JOIN outcomes o ON o.application_id = d.application_id) a
  CROSS JOIN (VALUES {_DATES}) t(days)"""


@query(
    "maturity_curve",
    with_views(
        f"""SELECT k.*, CAST(k.matured AS DOUBLE) / k.total AS maturity,
              CAST(k.labels AS DOUBLE) / k.matured AS coverage,
              ROUND(m.rate, 6) AS observed_default_rate, ROUND(m.auc, 6) AS observed_pr_auc
            FROM k LEFT JOIN (SELECT days, {PR_AUC} AS auc, {POSITIVE_RATE} AS rate
                              FROM c GROUP BY days) m ON m.days = k.days
            WHERE k.labels > 0""",
        "decisions",
        "outcomes",
        r=_CURVE,
        k="""SELECT days, COUNT(*) AS total, COUNT(*) FILTER (WHERE ready) AS matured,
               COUNT(*) FILTER (WHERE ready AND known) AS labels FROM r GROUP BY days""",
        **ranking_steps(
            """SELECT days, probability AS p, label AS y FROM r
               WHERE ready AND known AND prediction = 0""",
            by="days",
        ),
    ),
)
def maturity_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = labels.maturity_curve(
        standins.decisions(spark, sf),
        standins.outcomes(spark, sf),
        OFFSETS,
        bounds=score_bounds(spark, sf),
    )
    return rounded(curve, "observed_default_rate", "observed_pr_auc")


@query(
    "holdout_select",
    with_views(
        f"""SELECT *, prediction = 0 OR {uniform("application_id")} < {double(0.02)} AS observable,
              prediction = 1 AND {uniform("application_id")} < {double(0.02)} AS holdout
            FROM decisions""",
        "decisions",
    ),
)
def holdout_select(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.observe(standins.decisions(spark, sf), "application_id")


@query(
    "censoring_frame",
    with_views(
        f"""SELECT * FROM (
              SELECT application_id, predicted_at, prediction,
                prediction = 0 OR {uniform("application_id")} < {double(0.02)} AS observable,
                prediction = 1 AND {uniform("application_id")} < {double(0.02)} AS holdout,
                predicted_at + INTERVAL 30 DAY AS matures_at,
                CASE WHEN prediction = 0 OR {uniform("application_id")} < {double(0.02)}
                  THEN predicted_at + INTERVAL 30 DAY
                       + CAST(FLOOR({uniform("application_id", 7)} * 90) AS INT) * INTERVAL 1 DAY
                END AS observed_at
              FROM decisions)""",
        "decisions",
    ),
)
def censoring_frame(spark: SparkSession, sf: str) -> DataFrame:
    served = standins.decisions(spark, sf).select("application_id", "predicted_at", "prediction")
    lag = F.floor(hash_uniform("application_id", 7) * 90)
    return labels.censoring_frame(served, lag)


_SPLIT = f"""SELECT customer_id, default_payment_next_month AS y, k, n,
    CAST(ROUND(0.25::DOUBLE * n) AS BIGINT) AS n1,
    CAST(ROUND({double(0.2)} * (n - CAST(ROUND(0.25::DOUBLE * n) AS BIGINT))) AS BIGINT) AS n2
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY default_payment_next_month
                                     ORDER BY {uniform("customer_id")}, customer_id) AS k,
               COUNT(*) OVER (PARTITION BY default_payment_next_month) AS n FROM applications)"""
_COHORT = "CASE WHEN k <= n1 THEN 'current' WHEN k <= n1 + n2 THEN 'test' ELSE 'train' END"
SHARES = {"current": catalog.CURRENT_SHARE, "test": catalog.TEST_SHARE}


def split(spark: SparkSession, sf: str) -> DataFrame:
    apps = standins.applications(spark, sf)
    return sampling.stratified_split(apps, "customer_id", catalog.TARGET, SHARES, "train")


@query(
    "stratified_split",
    with_views(
        f"SELECT customer_id, y AS default_payment_next_month, {_COHORT} AS cohort FROM s",
        "applications",
        s=_SPLIT,
    ),
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("customer_id", catalog.TARGET, "cohort")


@query(
    "split_summary",
    with_views(
        f"""SELECT cohort, COUNT(*) AS rows, ROUND(AVG(y), 4) AS positive_rate FROM (
              SELECT {_COHORT} AS cohort, y FROM s
              UNION ALL SELECT 'reference', y FROM s WHERE k > n1) GROUP BY cohort""",
        "applications",
        s=_SPLIT,
    ),
)
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The reference cohort is train and test together."""
    names = F.when(F.col("cohort") == "current", F.array(F.lit("current"))).otherwise(
        F.array(F.col("cohort"), F.lit("reference"))
    )
    rows = split(spark, sf).select(F.explode(names).alias("cohort"), catalog.TARGET)
    return rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(catalog.TARGET), 4).alias("positive_rate")
    )


@query(
    "split_disjoint",
    with_views(
        """SELECT CAST(0 AS BIGINT) AS shared, COUNT(*) AS covered,
             COUNT(*) AS total FROM applications""",
        "applications",
    ),
)
def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in two cohorts (none), keys in any, keys in all."""
    rows = split(spark, sf).select("customer_id", "cohort")
    current = rows.where("cohort = 'current'").select("customer_id")
    reference = rows.where("cohort <> 'current'").select("customer_id")
    shared = current.intersect(reference).agg(F.count(F.lit(1))).scalar()
    total = standins.applications(spark, sf).agg(F.count(F.lit(1))).scalar()
    return rows.agg(F.count_distinct("customer_id").alias("covered")).select(
        shared.alias("shared"), "covered", total.alias("total")
    )


@query(
    "kfold_assign",
    with_views(
        f"""SELECT customer_id, default_payment_next_month,
              CAST((ROW_NUMBER() OVER (PARTITION BY default_payment_next_month
                ORDER BY {uniform("customer_id")}, customer_id) - 1) % 5 AS INT) AS fold
            FROM applications""",
        "applications",
    ),
)
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    apps = standins.applications(spark, sf).select("customer_id", catalog.TARGET)
    return sampling.kfold(apps, "customer_id", catalog.TARGET, 5)


@query(
    "cohort_union",
    with_views(
        f"""SELECT customer_id, cohort, bill_amt1 FROM (
              SELECT s.customer_id, {_COHORT} AS cohort, a.bill_amt1
              FROM s JOIN applications a ON a.customer_id = s.customer_id)
            WHERE cohort IN ('train', 'test')""",
        "applications",
        s=_SPLIT,
    ),
)
def cohort_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(spark, sf).select("customer_id", "cohort", "bill_amt1")
    return rows.where("cohort = 'train'").unionByName(rows.where("cohort = 'test'"))


@query(
    "distinct_counts",
    with_views(
        """SELECT DATE_TRUNC('year', statement_month)::DATE AS year,
             COUNT(DISTINCT customer_id) AS customers,
             COUNT(DISTINCT statement_month) AS statement_dates
           FROM monthly_events GROUP BY 1""",
        "monthly_events",
    ),
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    year = F.trunc("statement_month", "year").alias("year")
    return standins.monthly_events(spark, sf).groupBy(year).agg(
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("statement_month").alias("statement_dates"),
    )
