"""The driver's tables seen as decision data.

Money is in whole cents, so sums are exact whatever order they are taken in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.sources.tables import table


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def monthly_events(spark: SparkSession, sf: str) -> DataFrame:
    """Statements: one per order."""
    bill = cents("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("statement_month"),
        F.col("o_orderkey").alias("event_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 3).alias("pay_status"),
        bill.alias("bill_amt"),
        F.floor(bill * (F.col("o_orderkey") % 11) / 10).cast("bigint").alias("pay_amt"),
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Entities: the limit is below zero for some."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        cents("c_acctbal").alias("limit_bal"),
        F.col("c_mktsegment").alias("segment"),
    )


def application_id(key: str) -> Column:
    return F.concat(F.lit("APP-"), F.lpad(F.col(key).cast("string"), 9, "0"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Served decisions: one per order, about two in five declined."""
    return decisions_of(table(spark, sf, "orders"))


def decisions_of(orders: DataFrame) -> DataFrame:
    total = cents("o_totalprice")
    return orders.select(
        application_id("o_orderkey").alias("application_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("predicted_at"),
        # The share of 500,000 in steps of 0.0001, rounded in whole numbers.
        (F.floor((total + 2500) / 5000) / 10000.0).alias("probability"),
        (total >= 29_000_000).cast("int").alias("prediction"),
    )


def line_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Label and reporting lag per order: three returned lines or more count as bad."""
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    made = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(returned.alias("_r"), F.sum(F.col("l_quantity").cast("int")).alias("_q"))
    )
    bad = F.col("_r") >= 3
    return made.select(
        "l_orderkey",
        bad.cast("int").alias("label"),
        (F.col("_q") % 45 + F.when(bad, 50).otherwise(20)).cast("int").alias("lag_days"),
    )


def outcomes_of(orders: DataFrame, facts: DataFrame) -> DataFrame:
    """Outcomes of orders; orders without lines never report."""
    closed = F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")
    lag = F.make_dt_interval(F.col("lag_days"))
    return orders.join(facts, orders["o_orderkey"] == facts["l_orderkey"]).select(
        application_id("o_orderkey").alias("application_id"),
        closed.alias("outcome_at"),
        (closed + lag).alias("observed_at"),
        "label",
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes_of(table(spark, sf, "orders"), line_facts(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with their outcome."""
    return decisions(spark, sf).join(
        outcomes(spark, sf).select("application_id", "observed_at", "label"), "application_id"
    )


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Served requests: one per event."""
    return log_of(table(spark, sf, "events"))


def log_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").alias("predicted_at"),
        F.concat(F.lit("caller-"), (F.col("user_id") % 7).cast("string")).alias("caller"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 1000.0).alias("latency_s"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("probability"),
        F.col("props").alias("features"),
    )


def restated_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes, then all of them once more with the label turned and a later report."""
    first = outcomes(spark, sf)
    again = first.select(
        "application_id",
        "outcome_at",
        (F.col("observed_at") + F.expr("INTERVAL 10 DAY")).alias("observed_at"),
        (1 - F.col("label")).alias("label"),
    )
    return first.unionByName(again)


def cohort_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines shipped before 1998 (reference) and since (current)."""
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf, "lineitem").withColumn(
        "cohort", F.when(early, "reference").otherwise("current")
    )


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CODES = ["l_returnflag", "l_linestatus"]


#: First days of the second to sixth of six periods that cover all order dates.
PERIOD_STARTS = ["1996-02-01", "1997-03-01", "1998-04-01", "1999-05-01", "2000-07-01"]


def applications(spark: SparkSession, sf: str) -> DataFrame:
    """Wide application records, codes raw: all orders of every customer in six periods, oldest first.

    Bills and payments of a period are summed and its worst status kept. A period without
    orders has zero amounts and the status -2, so no customer falls out. One hash
    aggregate, combined before the shuffle; a customer with many orders is no burden.
    """
    orders = monthly_events(spark, sf)
    starts = [F.lit(d).cast("date") for d in PERIOD_STARTS]
    period = sum(((F.col("statement_month") >= d).cast("int") for d in starts), F.lit(1))
    orders = orders.withColumn("_period", F.coalesce(period, F.lit(1)))

    def within(i: int, column: str) -> Column:
        return F.when(F.col("_period") == i, F.col(column))

    cells, empty = [], {}
    for i, (status, suffix) in enumerate(
        [("pay_6", 6), ("pay_5", 5), ("pay_4", 4), ("pay_3", 3), ("pay_2", 2), ("pay_0", 1)], 1
    ):
        cells += [
            F.max(within(i, "pay_status")).alias(status),
            F.sum(within(i, "bill_amt")).alias(f"bill_amt{suffix}"),
            F.sum(within(i, "pay_amt")).alias(f"pay_amt{suffix}"),
        ]
        empty |= {status: -2, f"bill_amt{suffix}": 0, f"pay_amt{suffix}": 0}
    wide = orders.groupBy("customer_id").agg(*cells)
    entity = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        cents("c_acctbal").alias("limit_bal"),
        (F.col("c_custkey") % 2 + 1).cast("int").alias("sex"),
        (F.col("c_nationkey") % 7).cast("int").alias("education"),
        (F.col("c_nationkey") % 4).cast("int").alias("marriage"),
        (F.col("c_custkey") % 90 + 16).cast("int").alias("age"),
    )
    # A planted signal: the worse the newest status, the likelier the target.
    mix = F.pmod(F.col("customer_id") * 7919 + F.col("bill_amt1"), F.lit(100))
    target = (mix < 10 + 10 * (F.col("pay_0") + 2)).cast("int")
    joined = entity.join(wide, "customer_id", "left").fillna(empty)
    return joined.select(*wide.columns, *entity.columns[1:]).withColumn("default_payment_next_month", target)
