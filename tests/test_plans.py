"""What the plans must and must not contain, and that hot groups stay spread."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import hash_uniform
from riskflow.operators import labels, metrics
from riskflow.operators.prefix import _RANGE, range_bounds, row_positions, with_range
from riskflow.plans import QUERIES
from riskflow.plans.models import KEY

PYTHON_FREE = [
    "pit_features", "pit_features_running", "label_join", "maturity_curve", "pr_auc",
    "performance_compare", "threshold_choice", "fairness_audit", "drift_numeric", "win_rate",
    "alert_rules", "contract_quarantine", "stratified_split", "reason_codes",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not re.search(r"Python|Pandas|InArrow", text)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["pr_auc", "pr_curve", "calibration", "roc_auc_weighted"])
def test_global_orders_run_in_ranges(spark, name):
    """A window over everything may only see the totals of the ranges."""
    text = plan(QUERIES[name](spark, SMALL))
    for line in text.splitlines():
        if re.search(r"[+:]- Window \[", line) and f"{_RANGE}#" not in line:
            assert "_tot_" in line, line


def test_scan_reads_two_columns_and_filters(spark):
    text = plan(QUERIES["scan_projected"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,250000.0)]" in text
    assert "o_custkey" not in text


def test_the_window_is_taken_from_the_literal(spark):
    text = plan(QUERIES["matured_decisions"](spark, SMALL))
    assert "LessThanOrEqual(o_orderdate,1999-05-02T00:00" in text


def test_folded_cells_are_shuffled_once(spark):
    df = QUERIES["drift_numeric"](spark, SMALL)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_as_of_events_fold_before_the_shuffle(spark):
    text = plan(QUERIES["pit_features"](spark, SMALL))
    assert "SortAggregate" not in text and "partial_max_by" in text
    assert re.search(r"PushedFilters: \[[^]]*o_orderdate", text) or "DataFilters: [isnotnull" in text


def spread(df, *keys):
    """Largest share of the rows that one task of a window over the keys would hold."""
    counts = df.groupBy(*keys).count()
    total = df.count()
    return counts.agg(F.max("count")).first()[0] / total


def test_hot_score_is_one_cell_and_ranges_stay_even(spark):
    df = spark.range(30_000).withColumn(
        "p", F.when(F.col("id") % 3 == 0, 0.5).otherwise(hash_uniform("id", 1))
    )
    cells = df.groupBy("p").count()
    ranged = with_range(cells, "p", range_bounds(df, "p", 12))
    assert spread(ranged, _RANGE) < 0.2


def test_two_strata_are_numbered_in_many_tasks(spark):
    df = spark.range(9000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    made = row_positions(df, ["y"], hash_uniform("id", 3), ["id"])
    whole = df.withColumn(
        "want",
        F.row_number().over(Window.partitionBy("y").orderBy(hash_uniform("id", 3), "id")),
    )
    both = made.join(whole.select("id", "want"), "id")
    assert both.where("position <> want").count() == 0
    assert made.where("group_size <> if(y = 1, 3000, 6000)").count() == 0


def test_a_third_of_decisions_without_a_key(spark):
    """They neither match nor meet in a join task."""
    decisions = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("A"), F.col("id"))).alias("application_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("predicted_at"),
        F.lit(0.5).alias("probability"),
        F.lit(0).alias("prediction"),
    )
    outcomes = decisions.select(
        "application_id",
        F.lit("2024-02-01").cast("timestamp_ntz").alias("outcome_at"),
        F.lit("2024-02-02").cast("timestamp_ntz").alias("observed_at"),
        F.lit(1).alias("label"),
    )
    c = labels.join_counts(decisions, outcomes, "2025-01-01 00:00:00").first()
    assert (c.total, c.observed, c.pending) == (3000, 2000, 1000)


def test_restated_key_with_a_third_of_the_feed(spark):
    feed = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("application_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("outcome_at"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("observed_at"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    made = labels.first_reports(feed)
    assert made.count() == 6001
    assert made.where("application_id = 'hot'").first().label == 0
    assert "partial_min" in plan(made)


def test_results_do_not_depend_on_the_ranges(spark):
    df = spark.range(2000).select(
        F.round(hash_uniform("id", 1), 2).alias("probability"),
        (hash_uniform("id", 2) < 0.2).cast("int").alias("label"),
    )
    found = {
        round(metrics.ranking(df, "label", "probability", bounds=b).first().pr_auc, 12)
        for b in ([], [0.5], [0.01, 0.02, 0.03], [i / 50 for i in range(1, 50)])
    }
    assert len(found) == 1


def test_train_and_test_rows_do_not_share_keys(spark):
    from riskflow.plans.models import parts, records

    train, test = parts(records(spark, SMALL))
    assert train.select(KEY).intersect(test.select(KEY)).isEmpty()
