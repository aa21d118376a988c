"""Streaming queries. Each runs over all stored rows of its table and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import monitor, sketches
from riskflow.operators.contract import Contract, Rule
from riskflow.plans import standins, watch
from riskflow.plans.oracle import double, with_views
from riskflow.plans.registry import query, rounded
from riskflow.session import shared_folder
from riskflow.sources.store import OutcomeStore
from riskflow.streaming import live
from riskflow.streaming.runs import appended, table_stream, updated, wall_clock

REQUEST = Contract(
    (
        Rule("total", kind="double", gt=0, le=400_000.0),
        Rule("urgency", members=[1, 2, 3, 4]),
        Rule("status", kind="string", members=["F", "O"]),
    )
)
# A fixed logistic score, so that SQL can repeat it.
INTERCEPT, PER_TOTAL, PER_URGENCY = -3.0, 0.000008, 0.25
CUTOFF = 0.4


def logistic(df: DataFrame) -> DataFrame:
    margin = INTERCEPT + PER_TOTAL * F.col("total") + PER_URGENCY * F.col("urgency")
    return df.withColumn("probability", 1.0 / (1.0 + F.exp(-margin)))


_RULES = """CONCAT_WS(',',
    CASE WHEN NOT (o_totalprice > 0 AND o_totalprice <= 400000.0) THEN 'total' END,
    CASE WHEN CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) NOT IN (1, 2, 3, 4) THEN 'urgency' END,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END)"""


@query(
    "stream_score",
    f"""SELECT o_orderkey, reasons = '' AS accepted, reasons,
          CASE WHEN reasons = '' THEN ROUND(p, 9) END AS probability,
          CASE WHEN reasons = '' THEN CASE WHEN p >= {double(CUTOFF)} THEN 1 ELSE 0 END END
            AS prediction
        FROM (SELECT o_orderkey, {_RULES} AS reasons,
                1 / (1 + EXP(-({double(INTERCEPT)} + {double(PER_TOTAL)} * o_totalprice
                  + {double(PER_URGENCY)} * CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT)))) AS p
              FROM orders)""",
)
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    requests = table_stream(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("total"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("urgency"),
        F.col("o_orderstatus").alias("status"),
    )
    scored = live.score_stream(requests, REQUEST, logistic, "probability", CUTOFF, "fixed")
    root = shared_folder(spark)
    live.log_scored(scored, f"{root}/log", f"{root}/checkpoint")
    stored = spark.read.schema(scored.schema).parquet(f"{root}/log")
    return rounded(
        stored.select(
            "o_orderkey",
            "accepted",
            F.array_join("reasons", ",").alias("reasons"),
            "probability",
            "prediction",
        ),
        "probability",
        places=9,
    )


@query(
    "stream_tumbling",
    with_views(
        """SELECT DATE_TRUNC('day', predicted_at)::TIMESTAMP AS window_start, COUNT(*) AS requests,
             COUNT(*) FILTER (WHERE status >= 500) AS errors
           FROM prediction_log GROUP BY 1""",
        "prediction_log",
    ),
)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """In update mode, so the windows that are still open count too."""
    log = standins.log_of(table_stream(spark, sf, "events"))
    made = updated(live.request_windows(log, "predicted_at", "status"), ["window_start"])
    return wall_clock(made, "window_start")


RANK_SLACK = sketches.rank_error()


@query(
    "stream_p95",
    with_views(
        f"""SELECT day AS window_start, MAX(n) AS n,
              MIN(latency_s) FILTER (WHERE i >= GREATEST(CEIL({double(0.95 - RANK_SLACK)} * n), 1)) AS at_least,
              MIN(latency_s) FILTER (WHERE i >= CEIL({double(0.95 + RANK_SLACK)} * n)) AS at_most,
              TRUE AS inside
            FROM (SELECT latency_s, DATE_TRUNC('day', predicted_at)::TIMESTAMP AS day,
                    ROW_NUMBER() OVER (PARTITION BY DATE_TRUNC('day', predicted_at) ORDER BY latency_s) AS i,
                    COUNT(*) OVER (PARTITION BY DATE_TRUNC('day', predicted_at)) AS n
                  FROM prediction_log) GROUP BY day""",
        "prediction_log",
    ),
)
def stream_p95(spark: SparkSession, sf: str) -> DataFrame:
    """Daily p95 from hourly sketches of a stream, held against the exact values at the
    ranks that the sketch's error allows."""
    log = live.with_end(standins.log_of(table_stream(spark, sf, "events")), "predicted_at")
    panes = appended(live.quantile_panes(log, "predicted_at", "latency_s"))
    found = sketches.merged_quantiles(panes, {"p95": 0.95}, 60, 1440).drop("n")
    allowed = {"at_least": 0.95 - RANK_SLACK, "at_most": 0.95 + RANK_SLACK}
    exact = monitor.window_quantiles(
        standins.prediction_log(spark, sf), "predicted_at", "latency_s", allowed, size=1440
    )
    inside = F.coalesce(F.col("p95").between(F.col("at_least"), F.col("at_most")), F.lit(False))
    joined = exact.join(found, "window_start", "full")
    return joined.select("window_start", "n", *allowed, inside.alias("inside"))


@query(
    "stream_session",
    with_views(
        """SELECT caller, MIN(predicted_at) AS session_start,
             MAX(predicted_at) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS requests
           FROM (SELECT *, SUM(fresh) OVER (PARTITION BY caller ORDER BY predicted_at
                                            ROWS UNBOUNDED PRECEDING) AS s
                 FROM (SELECT *, CASE WHEN predicted_at < LAG(predicted_at) OVER (
                         PARTITION BY caller ORDER BY predicted_at) + INTERVAL 30 MINUTE
                         THEN 0 ELSE 1 END AS fresh FROM prediction_log))
           GROUP BY caller, s""",
        "prediction_log",
    ),
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as the watermark closes them, the last ones at the end of the feed."""
    log = live.with_end(standins.log_of(table_stream(spark, sf, "events")), "predicted_at")
    closed = appended(live.sessions(log, "predicted_at", "caller"))
    return wall_clock(closed, "session_start", "session_end")


@query(
    "stream_silence",
    with_views(
        """SELECT caller, predicted_at + INTERVAL 15 MINUTE AS at, 'silent' AS state
           FROM g WHERE after IS NULL OR after > predicted_at + INTERVAL 15 MINUTE
           UNION ALL SELECT caller, after, 'back' FROM g WHERE after > predicted_at + INTERVAL 15 MINUTE""",
        "prediction_log",
        g="""SELECT caller, predicted_at, LEAD(predicted_at) OVER (
               PARTITION BY caller ORDER BY predicted_at) AS after FROM prediction_log""",
    ),
)
def stream_silence(spark: SparkSession, sf: str) -> DataFrame:
    """When each caller fell silent for 15 minutes, and when it came back."""
    log = live.with_end(standins.log_of(table_stream(spark, sf, "events")), "predicted_at")
    return wall_clock(appended(live.silence_states(log, "predicted_at", ["caller"])), "at")


def outcome_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes as a stream: orders as they come, with the facts of their stored lines."""
    return standins.outcomes_of(table_stream(spark, sf, "orders"), standins.line_facts(spark, sf))


@query(
    "stream_dedup",
    with_views("SELECT * FROM outcomes", "outcomes"),
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A feed that restates every outcome, brought in twice: the first reports stay."""
    first = outcome_stream(spark, sf)
    again = outcome_stream(spark, sf).select(
        "application_id",
        "outcome_at",
        (F.col("observed_at") + F.expr("INTERVAL 10 DAY")).alias("observed_at"),
        (1 - F.col("label")).alias("label"),
    )
    root = shared_folder(spark)
    store = OutcomeStore(spark, f"{root}/outcomes")
    live.ingest_outcomes(first.unionByName(again), store, f"{root}/first")
    live.ingest_outcomes(first.unionByName(again), store, f"{root}/replay")
    return store.read()


@query(
    "stream_label_join",
    with_views(
        """SELECT d.application_id, d.predicted_at, d.probability, d.prediction, o.observed_at,
             o.label
           FROM decisions d LEFT JOIN outcomes o ON o.application_id = d.application_id""",
        "decisions",
        "outcomes",
    ),
)
def stream_label_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams joined within a horizon past the longest lag; the join itself tells
    which decisions stay without a label, once the watermark has passed their horizon."""
    decisions = standins.decisions_of(table_stream(spark, sf, "orders")).drop("customer_id")
    decisions = live.with_end(decisions, "predicted_at")
    outcomes = live.with_end(outcome_stream(spark, sf).drop("outcome_at"), "observed_at", key="application_id")
    columns = ["application_id", "predicted_at", "probability", "prediction", "observed_at", "label"]
    joined = live.label_stream(decisions, outcomes, horizon_days=150, how="leftOuter")
    return wall_clock(appended(joined).select(*columns), "predicted_at", "observed_at")


@query(
    "stream_alert_state",
    with_views(
        """SELECT rule, started_at + hold * INTERVAL 1 MINUTE AS at, 'firing' AS state
           FROM st WHERE minutes >= hold
           UNION ALL
           SELECT s.rule, s.ended_at + e.step * INTERVAL 1 MINUTE, 'resolved'
           FROM st s JOIN (SELECT rule, MAX(step) AS step, MAX(window_start) AS last
                           FROM ev GROUP BY rule) e ON e.rule = s.rule
           WHERE s.minutes >= s.hold AND s.ended_at < e.last
           UNION ALL
           SELECT rule, MAX(window_start) + INTERVAL 60 MINUTE, 'no_data' FROM ev GROUP BY rule""",
        "prediction_log",
        **watch.ALERT_STEPS,
    ),
)
def stream_alert_state(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluations are stored first and then streamed through the alert states; when
    they end, timers tell that there is no data."""
    root = shared_folder(spark)
    rows = watch.evaluations(spark, sf)
    rows.write.parquet(f"{root}/evaluations")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/evaluations")
    stream = live.with_end(stream, "window_start")
    return wall_clock(appended(live.alert_states(stream)), "at")
