"""Queries on drift and on the monitored prediction log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import hash_uniform
from riskflow.operators import drift, monitor
from riskflow.plans import standins
from riskflow.plans.oracle import double, uniform, with_views
from riskflow.plans.registry import query, rounded
from riskflow.session import shared_folder
from riskflow.sources.summary import read_summary, write_summary

NUMBERS, CODES = standins.LINE_NUMBERS, standins.LINE_CODES
LIMIT = catalog.DRIFT_LIMIT


def cohort_rows(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Both cohorts in one read, marked by side."""
    return drift.sides(standins.cohort_lines(spark, sf), F.col("cohort") == "current", columns)


def _melted(rows: str, columns: list[str], kind: str, side: str = "cohort = 'current'") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS col, CAST({c} AS {kind}) AS x,
              CASE WHEN {side} THEN 1 ELSE 0 END AS side FROM {rows}"""
        for c in columns
    )


def numeric_steps(melted: str, tag: str = "") -> dict[str, str]:
    """Prefix sums over the folded values, then one row per column."""
    return {
        f"nm{tag}": melted,
        f"ng{tag}": f"""SELECT col, x, COUNT(*) FILTER (WHERE side = 0) AS r,
              COUNT(*) FILTER (WHERE side = 1) AS k FROM nm{tag} GROUP BY col, x""",
        f"nf{tag}": f"""SELECT col, x, r, k, LEAD(x) OVER w AS nx,
              CAST(SUM(r) OVER w AS DOUBLE) / SUM(r) OVER (PARTITION BY col) AS fr,
              CAST(SUM(k) OVER w AS DOUBLE) / SUM(k) OVER (PARTITION BY col) AS fk
            FROM ng{tag} WINDOW w AS (PARTITION BY col ORDER BY x)""",
        f"nd{tag}": f"""SELECT f.*, s.spread, w1 / GREATEST(s.spread, {double(drift.MIN_SPREAD)}) AS normed
            FROM (SELECT col, SUM(ABS(fr - fk) * (nx - x)) AS w1, MAX(ABS(fr - fk)) AS ks,
                    CAST(SUM(r) AS BIGINT) AS rr, CAST(SUM(k) AS BIGINT) AS rk, COUNT(*) AS dv
                  FROM nf{tag} GROUP BY col) f
            JOIN (SELECT col, STDDEV_POP(x) AS spread FROM nm{tag} WHERE side = 0 GROUP BY col) s
              ON s.col = f.col""",
    }


def code_steps(melted: str, tag: str = "") -> dict[str, str]:
    return {
        f"cg{tag}": f"""SELECT col, x, COUNT(*) FILTER (WHERE side = 0) AS r,
              COUNT(*) FILTER (WHERE side = 1) AS k FROM ({melted}) GROUP BY col, x""",
        f"cs{tag}": f"""SELECT *, r / CAST(n AS DOUBLE) AS a, k / CAST(m AS DOUBLE) AS b,
              (r + k) * CAST(n AS DOUBLE) / (n + m) AS er, (r + k) * CAST(m AS DOUBLE) / (n + m) AS ek
            FROM (SELECT *, SUM(r) OVER (PARTITION BY col) AS n, SUM(k) OVER (PARTITION BY col) AS m
                  FROM cg{tag})""",
        f"cd{tag}": f"""SELECT col,
              SQRT(GREATEST(SUM(CASE WHEN a > 0 THEN 0.5::DOUBLE * a * LN(2 * a / (a + b)) ELSE 0 END
                + CASE WHEN b > 0 THEN 0.5::DOUBLE * b * LN(2 * b / (a + b)) ELSE 0 END), 0)) AS js,
              SUM((r - er) * (r - er) / er + (k - ek) * (k - ek) / ek) AS chi2, COUNT(*) - 1 AS dof,
              CAST(MAX(n) AS BIGINT) AS rr, CAST(MAX(m) AS BIGINT) AS rk FROM cs{tag} GROUP BY col""",
    }


_NUMERIC = numeric_steps(_melted("cohort_lines", NUMBERS, "DOUBLE"))
_CODES = code_steps(_melted("cohort_lines", CODES, "VARCHAR"))


@query(
    "drift_numeric",
    with_views(
        """SELECT col AS "column", ROUND(w1, 6) AS wasserstein, ROUND(normed, 6) AS normed,
             rr AS reference_rows, rk AS current_rows, dv AS distinct_values FROM nd""",
        "cohort_lines",
        **_NUMERIC,
    ),
)
def drift_numeric(spark: SparkSession, sf: str) -> DataFrame:
    made = drift.numeric_distances(cohort_rows(spark, sf, NUMBERS), NUMBERS)
    return rounded(
        made.select(
            "column", "wasserstein", "normed", "reference_rows", "current_rows", "distinct_values"
        ),
        "wasserstein",
        "normed",
    )


@query(
    "drift_ks",
    with_views(
        'SELECT col AS "column", ROUND(ks, 9) AS ks FROM nd', "cohort_lines", **_NUMERIC
    ),
)
def drift_ks(spark: SparkSession, sf: str) -> DataFrame:
    made = drift.numeric_distances(cohort_rows(spark, sf, NUMBERS), NUMBERS)
    return rounded(made.select("column", "ks"), "ks", places=9)


@query(
    "drift_categorical",
    with_views('SELECT col AS "column", ROUND(js, 8) AS js FROM cd', "cohort_lines", **_CODES),
)
def drift_categorical(spark: SparkSession, sf: str) -> DataFrame:
    made = drift.categorical_distances(cohort_rows(spark, sf, CODES), CODES)
    return rounded(made.select("column", "js"), "js", places=8)


@query(
    "drift_chi2",
    with_views(
        'SELECT col AS "column", ROUND(chi2, 6) AS chi2, dof FROM cd', "cohort_lines", **_CODES
    ),
)
def drift_chi2(spark: SparkSession, sf: str) -> DataFrame:
    made = drift.categorical_distances(cohort_rows(spark, sf, CODES), CODES)
    return rounded(made.select("column", "chi2", "dof"), "chi2")


PSI_EDGES = [5.0, 10.0, 20.0, 30.0, 40.0, 45.0]
_PSI_BIN = " + ".join(f"CASE WHEN l_quantity >= {e} THEN 1 ELSE 0 END" for e in PSI_EDGES)


@query(
    "drift_psi",
    with_views(
        f"""SELECT ROUND(SUM((b - a) * LN(b / a)), 8) AS psi FROM (
              SELECT GREATEST(r, 1) / CAST(SUM(r) OVER () AS DOUBLE) AS a,
                     GREATEST(k, 1) / CAST(SUM(k) OVER () AS DOUBLE) AS b
              FROM (SELECT {_PSI_BIN} AS bin, COUNT(*) FILTER (WHERE cohort = 'reference') AS r,
                      COUNT(*) FILTER (WHERE cohort = 'current') AS k
                    FROM cohort_lines GROUP BY 1))""",
        "cohort_lines",
    ),
)
def drift_psi(spark: SparkSession, sf: str) -> DataFrame:
    rows = cohort_rows(spark, sf, ["l_quantity"])
    return rounded(drift.psi(rows, "l_quantity", PSI_EDGES), "psi", places=8)


SCORE_EDGES = [0.01, 0.03, 0.07, 0.12, 0.23, 0.45]
_SCORE_BIN = " + ".join(f"CASE WHEN probability >= {double(e)} THEN 1 ELSE 0 END" for e in SCORE_EDGES)
#: Days of the span that every later day is held against, and of the trailing one.
SPAN_DAYS = 7


@query(
    "drift_psi_daily",
    with_views(
        """SELECT day, CAST(SUM(r) AS BIGINT) AS reference_rows, CAST(SUM(k) AS BIGINT) AS current_rows,
             ROUND(SUM((GREATEST(k, 1) / sk - GREATEST(r, 1) / sr)
               * LN((GREATEST(k, 1) / sk) / (GREATEST(r, 1) / sr))), 8) AS psi
           FROM (SELECT *, CAST(SUM(r) OVER (PARTITION BY day) AS DOUBLE) AS sr,
                   CAST(SUM(k) OVER (PARTITION BY day) AS DOUBLE) AS sk FROM spans) GROUP BY day""",
        "prediction_log",
        binned=f"""SELECT CAST(predicted_at AS DATE) AS day, {_SCORE_BIN} AS bin
                   FROM prediction_log""",
        bins=f"SELECT UNNEST(RANGE(0, {len(SCORE_EDGES) + 1})) AS bin",
        days=f"""SELECT CAST(UNNEST(GENERATE_SERIES(MIN(day) + INTERVAL {SPAN_DAYS} DAY, MAX(day),
                   INTERVAL 1 DAY)) AS DATE) AS day FROM binned""",
        spans=f"""SELECT d.day, b.bin,
                    (SELECT COUNT(*) FROM binned x WHERE x.bin = b.bin
                       AND x.day < (SELECT MIN(day) FROM binned) + INTERVAL {SPAN_DAYS} DAY) AS r,
                    (SELECT COUNT(*) FROM binned x WHERE x.bin = b.bin
                       AND x.day <= d.day AND x.day > d.day - INTERVAL {SPAN_DAYS} DAY) AS k
                  FROM days d, bins b""",
    ),
)
def drift_psi_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the last seven days against the first seven, for every day after them.

    The log is read once, for the cube; a day more costs one subtraction per bin."""
    path = shared_folder(spark)
    log = standins.prediction_log(spark, sf)
    drift.bin_cube(log, "predicted_at", "probability", SCORE_EDGES).write.mode("overwrite").parquet(path)
    cube = spark.read.parquet(path)
    first = F.date_from_unix_date(F.min("day"))
    ends = cube.agg(first.alias("r_first"), F.date_from_unix_date(F.max("day")).alias("_z"))
    starts = F.sequence(F.date_add("r_first", SPAN_DAYS), F.greatest("_z", F.date_add("r_first", SPAN_DAYS)))
    spans = ends.select("r_first", "_z", F.explode(starts).alias("k_last")).where("k_last <= _z")
    spans = spans.select(
        "r_first",
        F.date_add("r_first", SPAN_DAYS - 1).alias("r_last"),
        F.date_sub("k_last", SPAN_DAYS - 1).alias("k_first"),
        "k_last",
    )
    made = drift.psi_between(cube, spans)
    return rounded(
        made.select(F.col("k_last").alias("day"), "reference_rows", "current_rows", "psi"), "psi", places=8
    )


def report_sql(tag: str = "") -> str:
    """Distances of all columns."""
    return f"""
      SELECT col AS "column", 'wasserstein_normed' AS method, ROUND(normed, 6) AS score,
        {double(LIMIT)} AS threshold, normed > {double(LIMIT)} AS drifted,
        rr AS reference_rows, rk AS current_rows FROM nd{tag}
      UNION ALL
      SELECT col, 'jensen_shannon', ROUND(js, 6), {double(LIMIT)}, js > {double(LIMIT)}, rr, rk
      FROM cd{tag}"""


_SUMMARY = """SELECT *, drifted_share <= 0.3::DOUBLE AS passed FROM (
    SELECT COUNT(*) FILTER (WHERE drifted) AS drifted_columns, COUNT(*) AS monitored_columns,
      CAST(COUNT(*) FILTER (WHERE drifted) AS DOUBLE) / COUNT(*) AS drifted_share,
      MAX(reference_rows) AS reference_rows, MAX(current_rows) AS current_rows,
      0.3::DOUBLE AS threshold FROM report)"""


def report(spark: SparkSession, sf: str) -> DataFrame:
    return drift.report_of(cohort_rows(spark, sf, [*NUMBERS, *CODES]), NUMBERS, CODES)


@query(
    "drift_report",
    with_views(report_sql(), "cohort_lines", **_NUMERIC, **_CODES),
)
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report(spark, sf), "score")


@query(
    "drift_summary",
    with_views(_SUMMARY, "cohort_lines", **_NUMERIC, **_CODES, report=report_sql()),
)
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_summary(report(spark, sf))


# Columns whose p-values have closed sums: numbers, and codes of three values.
TESTED_CODES = ["l_returnflag"]


@query(
    "drift_test",
    with_views(
        f"""SELECT "column", method, ROUND(p, 9) AS score, 0.05::DOUBLE AS threshold, p < 0.05::DOUBLE AS drifted,
              reference_rows, current_rows
            FROM (
              SELECT col AS "column", 'ks' AS method, rr AS reference_rows, rk AS current_rows,
                CASE WHEN x < 0.2::DOUBLE THEN 1.0::DOUBLE ELSE LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, 2 * list_sum(
                  list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * EXP(-2.0::DOUBLE * k * k * x * x))))) END AS p
              FROM (SELECT *, SQRT(CAST(rr AS DOUBLE) * rk / (rr + rk)) * ks AS x FROM nd)
              UNION ALL
              SELECT col, 'chi2', rr, rk, EXP(-chi2 / 2) FROM cd
              WHERE col IN ({", ".join(f"'{c}'" for c in TESTED_CODES)}))""",
        "cohort_lines",
        **_NUMERIC,
        **_CODES,
    ),
)
def drift_test(spark: SparkSession, sf: str) -> DataFrame:
    """p-values of the tests, by the limit distributions."""
    rows = cohort_rows(spark, sf, [*NUMBERS, *TESTED_CODES])
    return rounded(drift.report_of(rows, NUMBERS, TESTED_CODES, method="test"), "score", places=9)


@query(
    "summary_json",
    with_views(_SUMMARY, "cohort_lines", **_NUMERIC, **_CODES, report=report_sql()),
)
def summary_json(spark: SparkSession, sf: str) -> DataFrame:
    """The drift summary, written as JSON and read back."""
    made = drift.drift_summary(report(spark, sf))
    path = shared_folder(spark)
    write_summary(made, path)
    return read_summary(spark, path, made.schema)


# A downturn in the current lines: quantities and prices shrink, return flags turn.
STRESSED = {"l_quantity": 0.7, "l_extendedprice": 0.7}
_LINE_U = uniform("l_orderkey || '-' || l_partkey || '-' || l_suppkey")
_STRESSED_LINES = f"""SELECT cohort,
    {", ".join(f"CASE WHEN cohort = 'current' THEN {c} * {double(f)} ELSE {c} END AS {c}"
               for c, f in STRESSED.items())},
    l_discount, l_tax, l_linestatus,
    CASE WHEN cohort = 'current' AND {_LINE_U} < 0.6::DOUBLE THEN 'R' ELSE l_returnflag END
      AS l_returnflag FROM cohort_lines"""
_STRESSED_STEPS = {
    "stressed": _STRESSED_LINES,
    **numeric_steps(_melted("stressed", NUMBERS, "DOUBLE")),
    **code_steps(_melted("stressed", CODES, "VARCHAR")),
    "report": report_sql(),
}


def stressed_report(spark: SparkSession, sf: str) -> DataFrame:
    lines, late = standins.cohort_lines(spark, sf), F.col("cohort") == "current"
    turned = hash_uniform(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"), 42) < 0.6
    lines = lines.withColumns(
        {
            **{c: F.when(late, F.col(c) * F.lit(f)).otherwise(F.col(c)) for c, f in STRESSED.items()},
            "l_returnflag": F.when(late & turned, "R").otherwise(F.col("l_returnflag")),
        }
    )
    return drift.report_of(drift.sides(lines, late, [*NUMBERS, *CODES]), NUMBERS, CODES)


@query(
    "drift_control",
    with_views(
        """SELECT "column", drifted, ROUND(score, 6) AS score, 'stressed' AS run FROM report
           UNION ALL
           SELECT "column", FALSE, CAST(0 AS DOUBLE), 'identical' FROM report""",
        "cohort_lines",
        **_STRESSED_STEPS,
    ),
)
def drift_control(spark: SparkSession, sf: str) -> DataFrame:
    """A cohort against itself does not drift; the stressed columns do, and no others."""
    old = standins.cohort_lines(spark, sf).where("cohort = 'reference'")
    same = drift.drift_report(old, old, NUMBERS, CODES)
    moved = stressed_report(spark, sf)
    keep = ["column", "drifted", "score"]
    both = moved.select(*keep, F.lit("stressed").alias("run")).unionByName(
        same.select(*keep, F.lit("identical").alias("run"))
    )
    return rounded(both, "score")


@query(
    "retrain_decision",
    with_views(
        f"SELECT *, NOT passed AS retrain, FALSE AS promote FROM ({_SUMMARY})",
        "cohort_lines",
        **_STRESSED_STEPS,
    ),
)
def retrain_decision(spark: SparkSession, sf: str) -> DataFrame:
    return drift.retrain_decision(drift.drift_summary(stressed_report(spark, sf)))


SEVERITY = 0.6
_STATUSES = [p[1] for p in reversed(catalog.PERIODS)]
_PAYMENTS = [f"pay_amt{i}" for i in range(1, 7)]
_SLIPS = f"{uniform('customer_id')} < {double(SEVERITY)}"
_SHIFTED = f"""SELECT customer_id,
    {", ".join(
        f"CASE WHEN {_SLIPS} THEN LEAST(GREATEST({c} + {1 + (42 + i) % 2}, -2), 9) ELSE {c} END AS {c}"
        for i, c in enumerate(_STATUSES))},
    GREATEST(CAST(FLOOR(limit_bal * {double(1 - 0.35 * SEVERITY)}) AS BIGINT), 10000) AS limit_bal,
    {", ".join(
        f"GREATEST(CAST(FLOOR({c} * {double(1 - 0.5 * SEVERITY)}) AS BIGINT), 0) AS {c}"
        for c in _PAYMENTS)}
  FROM applications"""


def shifted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    apps = standins.applications(spark, sf)
    return apps, drift.stress(
        apps, "customer_id", SEVERITY, _STATUSES, ["limit_bal"], _PAYMENTS
    )


@query("stress_shift", with_views("SELECT * FROM shifted", "applications", shifted=_SHIFTED))
def stress_shift(spark: SparkSession, sf: str) -> DataFrame:
    return shifted(spark, sf)[1].select("customer_id", *_STATUSES, "limit_bal", *_PAYMENTS)


@query(
    "shift_summary",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", (SELECT CAST(SUM({c}) AS DOUBLE) / COUNT(*) FROM applications)
                  AS mean_before,
                (SELECT CAST(SUM({c}) AS DOUBLE) / COUNT(*) FROM shifted) AS mean_after"""
            for c in ["limit_bal", "pay_0", "pay_amt1"]
        ),
        "applications",
        shifted=_SHIFTED,
    ),
)
def shift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.shift_summary(*shifted(spark, sf), ["limit_bal", "pay_0", "pay_amt1"])


_BOUNDS = ", ".join(double(b) for b in catalog.SCORE_BOUNDS)
_HISTOGRAM = f"""SELECT le, COUNT(*) FILTER (WHERE probability <= le) AS cumulative,
    COUNT(*) AS total FROM prediction_log CROSS JOIN (SELECT unnest([{_BOUNDS}]) AS le) GROUP BY le"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    return standins.prediction_log(spark, sf)


@query("score_histogram", with_views(_HISTOGRAM, "prediction_log"))
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.score_histogram(log(spark, sf), "probability")


SCORE_QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
_STEP = "(low + (le - low) * (({q}::DOUBLE * total - before) / (cumulative - before)))"
_PICKS = ", ".join(
    f"""ROUND(MAX(CASE WHEN before < {q}::DOUBLE * total AND {q}::DOUBLE * total <= cumulative
          THEN {_STEP.format(q=q)} END), 6) AS {name}"""
    for name, q in SCORE_QUANTILES.items()
)


@query(
    "score_quantiles",
    with_views(
        f"""SELECT {_PICKS} FROM (
              SELECT *, COALESCE(LAG(le) OVER (ORDER BY le), 0) AS low,
                     COALESCE(LAG(cumulative) OVER (ORDER BY le), 0) AS before FROM h)""",
        "prediction_log",
        h=_HISTOGRAM,
    ),
)
def score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    histogram = monitor.score_histogram(log(spark, sf), "probability")
    return rounded(
        monitor.histogram_quantiles(histogram, SCORE_QUANTILES), *SCORE_QUANTILES
    )


def _pane(minutes: int) -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', predicted_at, TIMESTAMP '1970-01-01')"


def _windows(size: int, slide: int) -> str:
    """Every row once per window that covers it."""
    return f"""SELECT l.*, {_pane(slide)} - back * INTERVAL '{slide} minutes' AS window_start
      FROM prediction_log l CROSS JOIN (SELECT unnest(range({size // slide})) AS back)"""


@query(
    "win_rate",
    with_views(
        """SELECT window_start, COUNT(*) AS requests, COUNT(*) / 300.0::DOUBLE AS rate
           FROM w GROUP BY window_start""",
        "prediction_log",
        w=_windows(5, 1),
    ),
)
def win_rate(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.request_rate(log(spark, sf), "predicted_at")


@query(
    "win_error_ratio",
    with_views(
        """SELECT window_start, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status >= 500) AS errors,
             CAST(COUNT(*) FILTER (WHERE status >= 500) AS DOUBLE) / COUNT(*) AS error_ratio
           FROM w GROUP BY window_start""",
        "prediction_log",
        w=_windows(5, 1),
    ),
)
def win_error_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.error_ratio(log(spark, sf), "predicted_at", "status")


@query(
    "win_p95",
    with_views(
        f"""SELECT {_pane(5)} AS window_start, COUNT(latency_s) AS n,
              quantile_disc(latency_s, 0.95) AS p95 FROM prediction_log GROUP BY 1""",
        "prediction_log",
    ),
)
def win_p95(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.window_quantiles(log(spark, sf), "predicted_at", "latency_s", {"p95": 0.95})


@query(
    "win_score_quantiles",
    with_views(
        f"""SELECT {_pane(5)} AS window_start, COUNT(probability) AS n,
              quantile_disc(probability, 0.5) AS p50, quantile_disc(probability, 0.9) AS p90,
              quantile_disc(probability, 0.99) AS p99 FROM prediction_log GROUP BY 1""",
        "prediction_log",
    ),
)
def win_score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.window_quantiles(
        log(spark, sf), "predicted_at", "probability", SCORE_QUANTILES
    )


@query(
    "win_mean_score",
    with_views(
        """SELECT window_start, COUNT(*) AS predictions, ROUND(AVG(probability), 12) AS mean_score
           FROM w GROUP BY window_start""",
        "prediction_log",
        w=_windows(15, 5),
    ),
)
def win_mean_score(spark: SparkSession, sf: str) -> DataFrame:
    made = monitor.mean_score(log(spark, sf), "predicted_at", "probability")
    return rounded(made, "mean_score", places=12)


@query(
    "win_flagged_share",
    with_views(
        """SELECT window_start, COUNT(*) AS predictions,
             COUNT(*) FILTER (WHERE probability > 0.5::DOUBLE) AS flagged,
             CAST(COUNT(*) FILTER (WHERE probability > 0.5::DOUBLE) AS DOUBLE) / COUNT(*)
               AS flagged_share
           FROM w GROUP BY window_start""",
        "prediction_log",
        w=_windows(5, 5),
    ),
)
def win_flagged_share(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.flagged_share(log(spark, sf), "predicted_at", "probability")


def _calendar(step: int) -> str:
    return f"""SELECT unnest(generate_series(MIN({_pane(step)}), MAX({_pane(step)}),
        INTERVAL '{step} minutes')) AS window_start FROM prediction_log"""


_SILENT = """SELECT c.window_start, COALESCE(n, 0) AS predictions, COALESCE(n, 0) = 0 AS silent
  FROM cal c LEFT JOIN (SELECT window_start, COUNT(*) AS n FROM w GROUP BY 1) k
    ON k.window_start = c.window_start"""


@query(
    "win_no_traffic",
    with_views(_SILENT, "prediction_log", w=_windows(15, 5), cal=_calendar(5)),
)
def win_no_traffic(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.silent_windows(log(spark, sf), "predicted_at")


# Latency and score limits that suit the stand-in log.
RULES = [
    replace(r, above=0.4) if r.name == "latency" else replace(r, above=0.6, below=0.4)
    if r.name == "score_drift" else r
    for r in monitor.ALERTS
]

_LB = monitor.LATENCY_BOUNDS


def _p95_sql() -> str:
    counts = ", ".join(
        f"COUNT(*) FILTER (WHERE latency_s <= {double(b)}) AS b{i}" for i, b in enumerate(_LB)
    )
    cases = []
    for i, b in enumerate(_LB):
        low, before = (double(_LB[i - 1]), f"b{i - 1}") if i else (double(0.0), "0")
        step = f"""CASE WHEN b{i} > {before}
            THEN (0.95::DOUBLE * n - {before}) / (b{i} - {before}) ELSE 0 END"""
        cases.append(f"WHEN b{i} >= 0.95::DOUBLE * n THEN {low} + ({double(b)} - {low}) * ({step})")
    return f"""SELECT window_start, CASE {" ".join(cases)} ELSE {double(_LB[-1])} END AS v
      FROM (SELECT window_start, COUNT(*) AS n, {counts} FROM w1 GROUP BY 1)"""


_VALUES = {
    "error_rate": """SELECT window_start, CAST(COUNT(*) FILTER (WHERE status >= 500) AS DOUBLE)
        / COUNT(*) AS v FROM w1 GROUP BY 1""",
    "latency": _p95_sql(),
    "score_drift": "SELECT window_start, AVG(probability) AS v FROM w5 GROUP BY 1",
    "no_traffic": "SELECT window_start, CAST(COUNT(*) AS DOUBLE) AS v FROM w5 GROUP BY 1",
}


def _evaluation(rule: monitor.AlertRule) -> str:
    hits = [f"v > {double(rule.above)}"] if rule.above is not None else []
    hits += [f"v < {double(rule.below)}"] if rule.below is not None else []
    none = "TRUE" if rule.no_data_alerts else "FALSE"
    return f"""SELECT '{rule.name}' AS rule, '{rule.severity}' AS severity, {rule.step} AS step,
        {rule.hold} AS hold, c.window_start, v AS value, COALESCE({" OR ".join(hits)}, {none}) AS breached
      FROM cal{rule.step} c LEFT JOIN ({_VALUES[rule.name]}) k ON k.window_start = c.window_start"""


ALERT_STEPS = {
    "w1": _windows(5, 1),
    "w5": _windows(15, 5),
    # The coarser calendar is the part of the fine one that falls on its steps.
    "cal1": _calendar(1),
    "cal5": """SELECT window_start FROM cal1
               WHERE CAST(EPOCH(window_start) AS BIGINT) % 300 = 0""",
    "ev": " UNION ALL ".join(_evaluation(r) for r in RULES),
    "isl": """SELECT rule, MIN(window_start) AS started_at, MAX(window_start) AS ended_at,
                COUNT(*) AS evaluations, MAX(hold) AS hold
              FROM (SELECT *, CAST(EPOCH(window_start) AS BIGINT) - step * 60 * ROW_NUMBER() OVER (
                      PARTITION BY rule ORDER BY window_start) AS island FROM ev WHERE breached)
              GROUP BY rule, island""",
    "st": """SELECT *, date_diff('minute', started_at, ended_at) AS minutes FROM isl""",
}


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.alert_evaluations(log(spark, sf), RULES)


@query(
    "alert_sustained",
    with_views(
        """SELECT rule, started_at, ended_at, evaluations, minutes, minutes >= hold AS fired
           FROM st""",
        "prediction_log",
        **ALERT_STEPS,
    ),
)
def alert_sustained(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.sustained(
        evaluations(spark, sf), "breached", F.col("step"), F.col("hold"), by=["rule"]
    )


@query(
    "alert_rules",
    with_views(
        """SELECT e.rule, e.severity, e.hold AS hold_minutes, COUNT(*) AS evaluations,
             COUNT(*) FILTER (WHERE e.breached) AS breaches,
             COALESCE(MAX(f.fired), 0) AS fired, MAX(f.first_started_at) AS first_started_at
           FROM ev e LEFT JOIN (SELECT rule, COUNT(*) AS fired, MIN(started_at) AS first_started_at
                                FROM st WHERE minutes >= hold GROUP BY rule) f ON f.rule = e.rule
           GROUP BY 1, 2, 3""",
        "prediction_log",
        **ALERT_STEPS,
    ),
)
def alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.alert_rules(evaluations(spark, sf))


@query(
    "slo_check",
    with_views(
        """SELECT *, failure_ratio <= 0.01::DOUBLE AND p95_latency <= 1 AS passed FROM (
             SELECT COUNT(*) AS requests, COUNT(*) FILTER (WHERE status >= 500) AS failures,
               CAST(COUNT(*) FILTER (WHERE status >= 500) AS DOUBLE) / COUNT(*) AS failure_ratio,
               ROUND(quantile_cont(latency_s, 0.5), 9) AS median_latency,
               ROUND(quantile_cont(latency_s, 0.95), 9) AS p95_latency,
               COUNT(*) / ((EPOCH_US(MAX(predicted_at)) - EPOCH_US(MIN(predicted_at))) / 1000000.0::DOUBLE)
                 AS throughput
             FROM prediction_log)""",
        "prediction_log",
    ),
)
def slo_check(spark: SparkSession, sf: str) -> DataFrame:
    made = monitor.slo_check(log(spark, sf), "predicted_at", "status", "latency_s")
    return rounded(made, "median_latency", "p95_latency", places=9)
