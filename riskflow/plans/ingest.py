"""Queries on scans, sinks, the contract, reshaping and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions import scalar
from riskflow.operators import contract, labels, reshape
from riskflow.plans import standins
from riskflow.plans.oracle import double, with_views
from riskflow.plans.registry import query
from riskflow.session import shared_folder
from riskflow.sources import log, tables


@query(
    "scan_projected",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 250000",
)
def scan_projected(spark: SparkSession, sf: str) -> DataFrame:
    orders = tables.table(spark, sf, "orders")
    return orders.where(F.col("o_totalprice") > 250000.0).select(
        "o_orderkey", "o_totalprice", "o_orderdate"
    )


_written: dict[tuple[str, str], str] = {}


def logged(spark: SparkSession, sf: str) -> str:
    """The prediction log in its partitioned form, written once per session and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _written:
        path = shared_folder(spark)
        rows = standins.prediction_log(spark, sf).withColumn(
            "features", F.from_json("features", "k INT")
        )
        log.append_log(rows, path)
        _written[at] = path
    return _written[at]


@query(
    "sink_partitioned_log",
    with_views(
        """SELECT CAST(predicted_at AS DATE) AS date, COUNT(*) AS n,
             COUNT(*) FILTER (WHERE status = 500) AS failures
           FROM prediction_log GROUP BY 1""",
        "prediction_log",
    ),
)
def sink_partitioned_log(spark: SparkSession, sf: str) -> DataFrame:
    stored = log.read_log(spark, logged(spark, sf))
    return stored.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        scalar.count_where(F.col("status") == 500).alias("failures"),
    )


@query(
    "scan_partitioned_log",
    with_views(
        """SELECT event_id, probability, CAST(json_extract_string(features, '$.k') AS INT) AS k,
             CAST(predicted_at AS DATE) AS date
           FROM prediction_log
           WHERE CAST(predicted_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
        "prediction_log",
    ),
)
def scan_partitioned_log(spark: SparkSession, sf: str) -> DataFrame:
    days = log.read_log(spark, logged(spark, sf), dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    return days.select("event_id", "probability", "k", "date")


@query(
    "retention_filter",
    with_views(
        """SELECT event_id, CAST(predicted_at AS DATE) AS date FROM prediction_log
           WHERE CAST(predicted_at AS DATE) >= DATE '2024-02-10' - 30""",
        "prediction_log",
    ),
)
def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    stored = log.read_log(spark, logged(spark, sf))
    return log.retained(stored, dt.date(2024, 2, 10)).select("event_id", "date")


@query(
    "recent_features_topn",
    with_views(
        """SELECT event_id, predicted_at, CAST(json_extract_string(features, '$.k') AS INT) AS k
           FROM prediction_log ORDER BY predicted_at DESC, event_id DESC LIMIT 10000""",
        "prediction_log",
    ),
)
def recent_features_topn(spark: SparkSession, sf: str) -> DataFrame:
    rows = standins.prediction_log(spark, sf).select("event_id", "predicted_at", "features")
    newest = tables.newest(rows, "predicted_at", 10_000, tie="event_id")
    return reshape.parse_documents(newest, "features", "k INT")


@query(
    "recent_features_500",
    with_views(
        """SELECT event_id, predicted_at, CAST(json_extract_string(features, '$.k') AS INT) AS k
           FROM prediction_log ORDER BY predicted_at DESC, event_id DESC LIMIT 500""",
        "prediction_log",
    ),
)
def recent_features_500(spark: SparkSession, sf: str) -> DataFrame:
    """As ``recent_features_topn`` with a number that every table of the tests exceeds."""
    rows = standins.prediction_log(spark, sf).select("event_id", "predicted_at", "features")
    newest = tables.newest(rows, "predicted_at", 500, tie="event_id")
    return reshape.parse_documents(newest, "features", "k INT")


_PARTLY_KEYED = """SELECT CASE WHEN o_orderkey % 10 <> 0 THEN application_id END AS application_id,
    d.customer_id, d.predicted_at, d.probability, d.prediction, o_orderkey
  FROM decisions d JOIN orders ON application_id = 'APP-' || LPAD(CAST(o_orderkey AS VARCHAR), 9, '0')"""


def partly_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of which a tenth came without a key of the caller."""
    number = F.substring("application_id", 5, 9).cast("bigint")
    rows = standins.decisions(spark, sf).withColumn("o_orderkey", number)
    return rows.withColumn(
        "application_id", F.when(F.col("o_orderkey") % 10 != 0, F.col("application_id"))
    )


@query(
    "keyed_decisions",
    with_views(
        """SELECT application_id, predicted_at, probability, prediction FROM part
           WHERE application_id IS NOT NULL""",
        "decisions",
        part=_PARTLY_KEYED,
    ),
)
def keyed_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keyed(partly_keyed(spark, sf)).select(
        "application_id", "predicted_at", "probability", "prediction"
    )


@query(
    "key_fill_strip",
    with_views(
        """SELECT COALESCE(application_id, 'GEN-' || SUBSTR(MD5(CAST(o_orderkey AS VARCHAR)), 1, 12))
             AS application_id, customer_id, probability FROM part""",
        "decisions",
        part=_PARTLY_KEYED,
    ),
)
def key_fill_strip(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("GEN-"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 12))
    filled = contract.filled_key(partly_keyed(spark, sf), "application_id", made)
    return filled.select("application_id", "customer_id", "probability")


@query(
    "outcomes_as_of",
    with_views(
        "SELECT * FROM outcomes WHERE observed_at <= TIMESTAMP '1999-06-01'", "outcomes"
    ),
)
def outcomes_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return labels.known_by(standins.outcomes(spark, sf), "1999-06-01 00:00:00")


@query(
    "normalise_columns",
    """SELECT c_custkey AS customer, c_acctbal AS balance,
         CAST(c_nationkey % 2 AS TINYINT) AS default_payment_next_month FROM customer""",
)
def normalise_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"),
        F.col("c_custkey").alias(" customer "),
        F.col("c_acctbal").alias("balance "),
        (F.col("c_nationkey") % 2).alias("default payment next month"),
    )
    return contract.normalise(raw, catalog.TARGET, "default payment next month", ["ID"])


@query(
    "log_features_json",
    with_views(
        """SELECT event_id, '{"caller":"' || caller || '","status":' || CAST(status AS VARCHAR)
             || ',"k":' || json_extract_string(features, '$.k') || '}' AS features
           FROM prediction_log""",
        "prediction_log",
    ),
)
def log_features_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = reshape.parse_documents(standins.prediction_log(spark, sf), "features", "k INT")
    return rows.select("event_id", reshape.to_document(["caller", "status", "k"]).alias("features"))


@query(
    "insert_if_absent",
    with_views(
        """SELECT application_id, outcome_at, observed_at, label FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY application_id
                                          ORDER BY observed_at, outcome_at, label) AS rn
             FROM restated_feed) f
           WHERE rn = 1 AND application_id NOT IN (
             SELECT application_id FROM outcomes WHERE observed_at <= TIMESTAMP '1998-01-01')""",
        "restated_feed",
    ),
)
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    store = labels.known_by(standins.outcomes(spark, sf), "1998-01-01 00:00:00")
    fresh = labels.insert_if_absent(store, standins.restated_feed(spark, sf))
    return fresh.select("application_id", "outcome_at", "observed_at", "label")


@query(
    "schema_evolution_union",
    with_views(
        """SELECT event_id, predicted_at, status,
             CASE WHEN predicted_at >= TIMESTAMP '2024-01-15' THEN caller END AS caller
           FROM prediction_log""",
        "prediction_log",
    ),
)
def schema_evolution_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = standins.prediction_log(spark, sf).select("event_id", "predicted_at", "status", "caller")
    cut = scalar.instant("2024-01-15 00:00:00")
    old = rows.where(F.col("predicted_at") < cut).drop("caller")
    return log.merged_schema(old, rows.where(F.col("predicted_at") >= cut)).select(
        "event_id", "predicted_at", "status", "caller"
    )


@query("clean_codes", with_views("SELECT customer_id, education, marriage FROM cleaned", "cleaned"))
def clean_codes(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = contract.clean(standins.applications(spark, sf))
    return cleaned.select("customer_id", "education", "marriage")


def _rule_sql(rule: contract.Rule) -> str:
    checks = [f"{rule.column} IS NOT NULL"]
    for sign, bound in ((">", rule.gt), (">=", rule.ge), ("<=", rule.le)):
        if bound is not None:
            checks.append(f"{rule.column} {sign} {bound}")
    if rule.members is not None:
        checks.append(f"{rule.column} IN ({', '.join(map(str, rule.members))})")
    return f"COALESCE({' AND '.join(checks)}, FALSE)"


@query(
    "contract_violations",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{r.column}' AS rule, COUNT(*) FILTER (WHERE NOT {_rule_sql(r)}) AS n_bad"
            " FROM cleaned"
            for r in contract.LABELLED.rules
        ),
        "cleaned",
    ),
)
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    return contract.LABELLED.violations(contract.clean(standins.applications(spark, sf)))


_REASONS = ", ".join(
    f"CASE WHEN NOT {_rule_sql(r)} THEN '{r.column}' END" for r in contract.RAW.rules
)


@query(
    "contract_quarantine",
    with_views(
        f"""SELECT customer_id, reasons = '' AS accepted, reasons FROM (
              SELECT customer_id, CONCAT_WS(',', {_REASONS}) AS reasons FROM applications)""",
        "applications",
    ),
)
def contract_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    judged = contract.RAW.judged(standins.applications(spark, sf))
    return judged.select(
        "customer_id",
        (F.size("reasons") == 0).alias("accepted"),
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "feature_projection",
    with_views(
        "SELECT customer_id, "
        + ", ".join(sum(catalog.model_inputs(), []))
        + " FROM applications",
        "applications",
    ),
)
def feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    numeric, categorical = catalog.model_inputs()
    return contract.project_features(
        standins.applications(spark, sf), numeric, categorical, keep=["customer_id"]
    )


@query(
    "apply_threshold",
    with_views(
        f"""SELECT application_id, probability,
              CASE WHEN probability >= {double(0.17)} THEN 1 ELSE 0 END AS decision FROM decisions""",
        "decisions",
    ),
)
def apply_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = standins.decisions(spark, sf).select("application_id", "probability")
    return contract.decide(rows, "probability", 0.17, "decision")


@query(
    "unfold_events",
    with_views(
        "SELECT customer_id, statement_month, pay_status, bill_amt, pay_amt FROM statements",
        "statements",
    ),
)
def unfold_events(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.unfold(standins.applications(spark, sf), "customer_id")


_WIDE = [c for p in catalog.PERIODS for c in p[1:]]


def _round_trip(apps: DataFrame) -> DataFrame:
    static = reshape.entities(apps, "customer_id", target=catalog.TARGET)
    return reshape.refold(reshape.unfold(apps, "customer_id"), static, "customer_id")


@query(
    "refold_wide",
    with_views(
        f"SELECT customer_id, {', '.join(catalog.STATIC)}, {catalog.TARGET}, {', '.join(_WIDE)}"
        " FROM applications",
        "applications",
    ),
)
def refold_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(standins.applications(spark, sf))


@query(
    "unfold_refold_diff",
    with_views(
        "SELECT COUNT(*) AS records, CAST(0 AS BIGINT) AS differing FROM applications",
        "applications",
    ),
)
def unfold_refold_diff(spark: SparkSession, sf: str) -> DataFrame:
    apps = standins.applications(spark, sf)
    again = _round_trip(apps).select("customer_id", *[F.col(c).alias(f"_{c}") for c in _WIDE])
    same = F.lit(True)
    for c in _WIDE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        apps.join(again, "customer_id", "left")
        .agg(F.count(F.lit(1)).alias("records"), scalar.count_where(~same).alias("differing"))
    )


@query(
    "entity_table",
    with_views(
        f"SELECT customer_id, {', '.join(catalog.STATIC)}, {catalog.TARGET} FROM applications",
        "applications",
    ),
)
def entity_table(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.entities(
        standins.applications(spark, sf), "customer_id", target=catalog.TARGET
    )


@query(
    "flatten_struct",
    with_views(
        """SELECT event_id, CAST(json_extract_string(features, '$.k') AS INT) AS features_k,
             caller AS served_caller, status AS served_status FROM prediction_log""",
        "prediction_log",
    ),
)
def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    nested = standins.prediction_log(spark, sf).select(
        "event_id",
        F.from_json("features", "k INT").alias("features"),
        F.struct("caller", "status").alias("served"),
    )
    return reshape.flatten(nested, "_")


@query(
    "json_features",
    with_views(
        """SELECT event_id, CAST(json_extract_string(features, '$.k') AS INT) AS k
           FROM prediction_log""",
        "prediction_log",
    ),
)
def json_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = standins.prediction_log(spark, sf).select("event_id", "features")
    return reshape.parse_documents(rows, "features", "k INT")


@query(
    "variant_features",
    with_views(
        """SELECT event_id, CAST(json_extract_string(features, '$.k') AS BIGINT) AS k
           FROM prediction_log""",
        "prediction_log",
    ),
)
def variant_features(spark: SparkSession, sf: str) -> DataFrame:
    """As ``json_features``, with keys and types found in the documents."""
    rows = standins.prediction_log(spark, sf).select("event_id", "features")
    return reshape.discover_documents(rows, "features")


@query(
    "variant_changing_features",
    with_views(
        """SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN json_extract_string(features, '$.k') END AS k,
             CASE WHEN event_id % 5 IN (1, 2) THEN latency_s END AS latency_s,
             CASE WHEN event_id % 5 = 2 THEN caller END AS caller
           FROM prediction_log""",
        "prediction_log",
    ),
)
def variant_changing_features(spark: SparkSession, sf: str) -> DataFrame:
    """Five generations of documents: as served, with one key and two keys more, with a
    retyped key, and with none."""
    k = F.get_json_object("features", "$.k")
    made = (
        F.when(F.col("event_id") % 5 == 0, F.col("features"))
        .when(F.col("event_id") % 5 == 1, F.to_json(F.struct(k.cast("int").alias("k"), "latency_s")))
        .when(F.col("event_id") % 5 == 2, F.to_json(F.struct(k.cast("int").alias("k"), "latency_s", "caller")))
        .when(F.col("event_id") % 5 == 3, F.to_json(F.struct(k.alias("k"))))
        .otherwise("{}")
    )
    rows = standins.prediction_log(spark, sf).select("event_id", made.alias("features"))
    return reshape.discover_documents(rows, "features")


@query(
    "scalar_clip_ratio",
    with_views(
        """SELECT customer_id, limit_bal, GREATEST(limit_bal, 1) AS floored,
             LEAST(GREATEST(bill_amt1, 1000000), 30000000) AS clipped,
             CASE WHEN limit_bal <> 0 THEN CAST(bill_amt1 AS DOUBLE) / CAST(limit_bal AS DOUBLE)
                  ELSE 0 END AS ratio,
             CASE WHEN pay_amt1 <> 0 THEN CAST(bill_amt1 AS DOUBLE) / CAST(pay_amt1 AS DOUBLE)
                  ELSE 0 END AS pay_ratio,
             ABS(limit_bal - bill_amt1) AS gap
           FROM applications""",
        "applications",
    ),
)
def scalar_clip_ratio(spark: SparkSession, sf: str) -> DataFrame:
    limit, bill, pay = F.col("limit_bal"), F.col("bill_amt1"), F.col("pay_amt1")
    return standins.applications(spark, sf).select(
        "customer_id",
        "limit_bal",
        scalar.at_least(limit, 1).alias("floored"),
        scalar.within(bill, 1_000_000, 30_000_000).alias("clipped"),
        scalar.ratio(bill, limit).alias("ratio"),
        scalar.ratio(bill, pay).alias("pay_ratio"),
        F.abs(limit - bill).alias("gap"),
    )


@query(
    "scalar_bands",
    with_views(
        """SELECT CASE WHEN age >= 18 AND age < 30 THEN '18-30' WHEN age >= 30 AND age < 45 THEN '30-45'
                       WHEN age >= 45 AND age < 60 THEN '45-60' WHEN age >= 60 AND age < 120 THEN '60-120'
                  END AS band, COUNT(*) AS n FROM applications GROUP BY 1""",
        "applications",
    ),
)
def scalar_bands(spark: SparkSession, sf: str) -> DataFrame:
    banded = standins.applications(spark, sf).select(
        scalar.band("age", catalog.AGE_EDGES).alias("band")
    )
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scalar_json",
    with_views(
        """SELECT event_id, json_extract_string(features, '$.k') AS text,
             CAST(json_extract_string(features, '$.k') AS INT) * 2 AS doubled,
             '{"k":' || json_extract_string(features, '$.k') || '}' AS document
           FROM prediction_log""",
        "prediction_log",
    ),
)
def scalar_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("features", "k INT")
    return standins.prediction_log(spark, sf).select(
        "event_id",
        F.get_json_object("features", "$.k").alias("text"),
        (parsed["k"] * 2).alias("doubled"),
        F.to_json(parsed).alias("document"),
    )


@query(
    "scalar_time",
    with_views(
        """SELECT application_id, predicted_at + INTERVAL 732 HOUR AS matures_at,
             CAST(predicted_at AS DATE) AS day, CAST(DATE_TRUNC('month', predicted_at) AS DATE) AS month,
             STRFTIME(predicted_at, '%Y-%m-%dT%H:%M:%S') AS iso,
             CAST(EPOCH(predicted_at) AS BIGINT) AS epoch,
             DATE_TRUNC('month', predicted_at) <= TIMESTAMP '1998-01-01' AS visible
           FROM decisions""",
        "decisions",
    ),
)
def scalar_time(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("predicted_at")
    return standins.decisions(spark, sf).select(
        "application_id",
        scalar.plus_days(at, 30.5).alias("matures_at"),
        F.to_date(at).alias("day"),
        F.trunc(F.to_date(at), "month").alias("month"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.unix_seconds(at.cast("timestamp")).alias("epoch"),
        (F.trunc(F.to_date(at), "month") <= F.lit(dt.date(1998, 1, 1))).alias("visible"),
    )


@query(
    "scalar_strings",
    """SELECT c_custkey, 'APP-' || LPAD(CAST(c_custkey AS VARCHAR), 6, '0') AS key,
         LOWER(c_mktsegment) AS lower_segment, LOWER(c_mktsegment) LIKE '%e' AS ends_with_e,
         SPLIT_PART(c_name, '#', 2) AS suffix, TRIM('  ' || c_name || ' ') AS trimmed,
         REPLACE('features.' || c_mktsegment, 'features.', '') AS stripped,
         CONCAT_WS(',', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS joined
       FROM customer""",
)
def scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return tables.table(spark, sf, "customer").select(
        "c_custkey",
        F.format_string("APP-%06d", "c_custkey").alias("key"),
        F.lower(segment).alias("lower_segment"),
        F.endswith(F.lower(segment), F.lit("e")).alias("ends_with_e"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("suffix"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
        F.replace(F.concat(F.lit("features."), segment), F.lit("features."), F.lit("")).alias(
            "stripped"
        ),
        F.array_join(F.array(segment, F.col("c_nationkey").cast("string")), ",").alias("joined"),
    )


