"""The stand-in views and shared steps as DuckDB SQL, for checking results."""

from __future__ import annotations

from riskflow import catalog

SINGLE_DAY_MONTHS = ", ".join(f"(DATE '{m}')" for m in catalog.MONTHS)


def double(x: float) -> str:
    """A literal that parses to exactly this double."""
    return f"CAST('{x!r}' AS DOUBLE)"


def uniform(key: str, seed: int = catalog.SEED) -> str:
    return f"(('0x' || SUBSTR(MD5('{seed}:' || ({key})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _applications() -> str:
    slots = [("pay_6", 6), ("pay_5", 5), ("pay_4", 4), ("pay_3", 3), ("pay_2", 2), ("pay_0", 1)]
    starts = ["1996-02-01", "1997-03-01", "1998-04-01", "1999-05-01", "2000-07-01"]
    period = "1 + " + " + ".join(f"(statement_month >= DATE '{d}')::INT" for d in starts)
    cells = []
    for i, (status, n) in enumerate(slots, 1):
        cells += [
            f"COALESCE(MAX(pay_status) FILTER (WHERE p = {i}), -2) AS {status}",
            f"COALESCE(SUM(bill_amt) FILTER (WHERE p = {i}), 0)::BIGINT AS bill_amt{n}",
            f"COALESCE(SUM(pay_amt) FILTER (WHERE p = {i}), 0)::BIGINT AS pay_amt{n}",
        ]
    return f"""
      SELECT w.*, CAST(ROUND(c.c_acctbal * 100) AS BIGINT) AS limit_bal,
             CAST(c.c_custkey % 2 + 1 AS INT) AS sex, CAST(c.c_nationkey % 7 AS INT) AS education,
             CAST(c.c_nationkey % 4 AS INT) AS marriage, CAST(c.c_custkey % 90 + 16 AS INT) AS age,
             CASE WHEN (w.customer_id * 7919 + w.bill_amt1) % 100 < 10 + 10 * (w.pay_0 + 2)
                  THEN 1 ELSE 0 END AS default_payment_next_month
      FROM (SELECT c_custkey AS customer_id, {", ".join(cells)}
            FROM customer LEFT JOIN (SELECT *, {period} AS p FROM monthly_events)
              ON customer_id = c_custkey GROUP BY c_custkey) w
      JOIN customer c ON c.c_custkey = w.customer_id"""


def feature_columns(time: str = "statement_month", tie: str = "event_id") -> str:
    """The event features over the joined rows, as select items."""
    order = f"(datediff('day', DATE '1970-01-01', CAST({time} AS DATE))::HUGEINT * 1000000000000 + {tie})"
    return f"""
      COUNT({time}) AS observed_months,
      arg_max(pay_status, {order}) AS pay_status_latest,
      MAX(pay_status) AS pay_status_max,
      COUNT(*) FILTER (WHERE pay_status > 0) AS months_delinquent,
      arg_max(bill_amt, {order}) AS bill_latest,
      CAST(SUM(bill_amt) AS DOUBLE) / COUNT(bill_amt) AS bill_mean,
      arg_max(bill_amt, {order}) - arg_min(bill_amt, {order}) AS bill_trend,
      arg_max(pay_amt, {order}) AS pay_amt_latest,
      CAST(SUM(pay_amt) AS DOUBLE) / COUNT(pay_amt) AS pay_amt_mean,
      ROUND(AVG(CAST(pay_amt AS DOUBLE) / CAST(GREATEST(bill_amt, 1) AS DOUBLE)), 6)
        AS payment_ratio_mean"""


def _events_of(table: str) -> str:
    rows = [
        f"SELECT customer_id, DATE '{m}' AS statement_month, {s} AS pay_status, "
        f"{b} AS bill_amt, {p} AS pay_amt, 0 AS event_id FROM {table}"
        for m, s, b, p in catalog.PERIODS
    ]
    return " UNION ALL ".join(rows)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "monthly_events": (
        (),
        """SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS statement_month,
             o_orderkey AS event_id,
             CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) - 3 AS pay_status,
             CAST(ROUND(o_totalprice * 100) AS BIGINT) AS bill_amt,
             CAST(ROUND(o_totalprice * 100) AS BIGINT) * (o_orderkey % 11) // 10 AS pay_amt
           FROM orders""",
    ),
    "customers": (
        (),
        """SELECT c_custkey AS customer_id, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS limit_bal,
             c_mktsegment AS segment FROM customer""",
    ),
    "decisions": (
        (),
        """SELECT 'APP-' || LPAD(CAST(o_orderkey AS VARCHAR), 9, '0') AS application_id,
             o_custkey AS customer_id, o_orderdate AS predicted_at,
             ((CAST(ROUND(o_totalprice * 100) AS BIGINT) + 2500) // 5000) / 10000.0::DOUBLE
               AS probability,
             CASE WHEN CAST(ROUND(o_totalprice * 100) AS BIGINT) >= 29000000 THEN 1 ELSE 0 END
               AS prediction
           FROM orders""",
    ),
    "outcomes": (
        (),
        """SELECT 'APP-' || LPAD(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS application_id,
             o.o_orderdate + INTERVAL 30 DAY AS outcome_at,
             o.o_orderdate + INTERVAL 30 DAY + l.lag_days * INTERVAL 1 DAY AS observed_at,
             l.label
           FROM orders o JOIN (
             SELECT l_orderkey,
               CASE WHEN COUNT(*) FILTER (WHERE l_returnflag = 'R') >= 3 THEN 1 ELSE 0 END AS label,
               CAST(SUM(CAST(l_quantity AS INT)) % 45
                 + CASE WHEN COUNT(*) FILTER (WHERE l_returnflag = 'R') >= 3
                        THEN 50 ELSE 20 END AS INT) AS lag_days
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    ),
    "labelled": (
        ("decisions", "outcomes"),
        """SELECT d.*, o.observed_at, o.label
           FROM decisions d JOIN outcomes o ON o.application_id = d.application_id""",
    ),
    "observed_rows": (
        ("labelled",),
        f"""SELECT * FROM labelled
            WHERE prediction = 0 OR {uniform("application_id")} < {double(0.02)}""",
    ),
    "weighed": (
        ("observed_rows",),
        f"""SELECT *, CASE WHEN prediction = 1 THEN 1.0::DOUBLE / {double(0.02)} ELSE 1.0::DOUBLE END
              AS weight FROM observed_rows""",
    ),
    "prediction_log": (
        (),
        """SELECT event_id, ts AS predicted_at, 'caller-' || CAST(user_id % 7 AS VARCHAR) AS caller,
             CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
             value / 1000.0::DOUBLE AS latency_s,
             LEAST(value / 500.0::DOUBLE, 1.0::DOUBLE) AS probability, props AS features
           FROM events""",
    ),
    "restated_feed": (
        ("outcomes",),
        """SELECT * FROM outcomes UNION ALL
           SELECT application_id, outcome_at, observed_at + INTERVAL 10 DAY, 1 - label
           FROM outcomes""",
    ),
    "cohort_lines": (
        (),
        """SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'reference'
                          ELSE 'current' END AS cohort FROM lineitem""",
    ),
    "applications": (("monthly_events",), _applications()),
    "cleaned": (
        ("applications",),
        """SELECT * REPLACE (CASE WHEN education IN (0, 5, 6) THEN 4 ELSE education END AS education,
                             CASE WHEN marriage IN (0) THEN 3 ELSE marriage END AS marriage)
           FROM applications""",
    ),
    "statements": (("applications",), _events_of("applications")),
}


def with_views(body: str, *views: str, **extra: str) -> str:
    """The body behind the views it uses, each with the views it needs itself."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    steps = [f"{name} AS ({VIEWS[name][1]})" for name in order]
    steps += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(steps)} {body}" if steps else body


def ranking_steps(rows: str, weight: str = "1", by: str = "") -> dict[str, str]:
    """Folded cells and their running totals for a select over ``p``, ``y`` and ``by``."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return {
        "g": f"""SELECT {lead}p, SUM(CASE WHEN y = 1 THEN {weight} ELSE 0 END)::DOUBLE AS tp,
                  SUM(CASE WHEN y = 0 THEN {weight} ELSE 0 END)::DOUBLE AS fp,
                  COUNT(*) AS n, SUM(({weight}) * ({weight}))::DOUBLE AS ww
                FROM ({rows}) GROUP BY {lead}p""",
        "c": f"""SELECT *, SUM(tp) OVER ({part} ORDER BY p DESC) AS ctp,
                  SUM(fp) OVER ({part} ORDER BY p DESC) AS cfp,
                  SUM(tp) OVER ({part}) AS atp, SUM(fp) OVER ({part}) AS afp FROM g""",
    }


PR_AUC = "SUM(CASE WHEN atp > 0 AND afp > 0 THEN CASE WHEN tp > 0 THEN tp / atp * (ctp / (ctp + cfp)) ELSE 0 END END)"
ROC_AUC = "SUM(CASE WHEN atp > 0 AND afp > 0 THEN fp / afp * ((ctp - tp / 2) / atp) END)"
BRIER = "SUM(tp * (1 - p) * (1 - p) + fp * p * p) / SUM(tp + fp)"
POSITIVE_RATE = "SUM(tp) / SUM(tp + fp)"
EFFECTIVE_ROWS = "SUM(tp + fp) * SUM(tp + fp) / SUM(ww)"
