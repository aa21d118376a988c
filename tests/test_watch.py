import datetime as dt
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.tails import chi_square_tail, kolmogorov_tail, normal_tail
from riskflow.operators import drift, monitor

NUMERIC, CODES = ["limit_bal", "bill_amt1", "pay_amt1", "age"], ["sex", "education", "pay_0"]


@pytest.fixture(scope="module")
def cohorts(spark, applications):
    """3,000 rows: the 400 records with jitter, so that the distances are used."""
    big = applications.crossJoin(spark.range(8).withColumnRenamed("id", "copy"))
    big = big.withColumns(
        {c: F.col(c) + F.pmod(F.xxhash64("customer_id", "copy", F.lit(c)), F.lit(97)) for c in NUMERIC}
    )
    big = big.withColumn("key", F.col("customer_id") * 10 + F.col("copy")).cache()
    return big.where("copy < 4"), big.where("copy >= 4")


def drifted(report):
    return {r.column for r in report.collect() if r.drifted}


def test_alike_cohorts_do_not_drift(cohorts):
    report = drift.drift_report(*cohorts, NUMERIC, CODES)
    assert report.count() == 7 and drifted(report) == set()
    assert {r.method for r in report.collect()} == {"wasserstein_normed", "jensen_shannon"}
    assert drift.drift_summary(report).first().passed


def test_shifted_columns_are_flagged_and_no_others(cohorts):
    old, new = cohorts
    moved = drift.stress(new, "key", 0.9, ["pay_0"], ["limit_bal"], ["pay_amt1"])
    report = drift.drift_report(old, moved, NUMERIC, CODES)
    assert drifted(report) == {"pay_0", "limit_bal", "pay_amt1"}
    verdict = drift.retrain_decision(drift.drift_summary(report)).first()
    assert (verdict.passed, verdict.retrain, verdict.promote) == (False, True, False)
    calm = drift.drift_summary(drift.drift_report(old, old, NUMERIC, CODES))
    assert drift.retrain_decision(calm).first().retrain is False
    assert drift.retrain_decision(calm, force=True).first().retrain is True


def test_the_method_is_chosen_and_never_the_size(cohorts):
    old, new = (c.where("customer_id < 150") for c in cohorts)
    small = {r.method for r in drift.drift_report(old, new, NUMERIC, CODES).collect()}
    assert small == {"wasserstein_normed", "jensen_shannon"}
    made = drift.drift_report(old, new, NUMERIC, CODES, method="test")
    report = {r.column: r for r in made.collect()}
    assert report["age"].method == "ks" and report["sex"].method == "z"
    assert report["education"].method == "chi2"
    assert not any(r.drifted for r in report.values())
    assert all(0 <= r.score <= 1 for r in report.values())
    moved = new.withColumn("sex", F.lit(1))
    again = drift.drift_report(old, moved, [], ["sex"], method="test").first()
    assert again.drifted and again.score < 0.001
    with pytest.raises(ValueError, match="neither"):
        drift.drift_report(old, new, NUMERIC, CODES, method="auto")


def test_distances_against_numpy(cohorts):
    old, new = cohorts
    made = drift.numeric_distances(drift.both(old, new, ["bill_amt1"]), ["bill_amt1"]).first()
    a = np.sort(old.toPandas()["bill_amt1"].to_numpy(dtype=float))
    b = np.sort(new.toPandas()["bill_amt1"].to_numpy(dtype=float))
    x = np.sort(np.concatenate([a, b]))
    gap = np.abs(
        np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)
    )
    w1 = (gap[:-1] * np.diff(x)).sum()
    assert made.wasserstein == pytest.approx(w1) and made.ks == pytest.approx(gap.max())
    assert made.normed == pytest.approx(w1 / a.std())


def test_the_lists_say_what_a_column_is(cohorts):
    assert drift.drift_report(*cohorts, ["sex"], []).first().method == "wasserstein_normed"
    assert drift.drift_report(*cohorts, [], ["sex"]).first().method == "jensen_shannon"


def test_tails_have_known_values():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi_square_tail(2.0, 2) == pytest.approx(math.exp(-1))
    assert normal_tail(1.959963984540054) == pytest.approx(0.05)
    assert kolmogorov_tail(1.3580986 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-4)


def test_stress_moves_what_it_says(applications):
    moved = drift.stress(applications, "customer_id", 0.6, ["pay_0"], ["limit_bal"], ["pay_amt1"])
    means = {r.column: r for r in drift.shift_summary(applications, moved, ["pay_0", "limit_bal", "pay_amt1", "age"]).collect()}
    assert means["pay_0"].mean_after > means["pay_0"].mean_before
    assert means["limit_bal"].mean_after < means["limit_bal"].mean_before
    assert means["age"].mean_after == means["age"].mean_before
    assert moved.where("limit_bal < 10000 or pay_0 > 9").count() == 0
    assert rows(drift.stress(applications, "customer_id", 0.0)) == rows(applications)


START = dt.datetime(2024, 1, 1)


def log(spark, minutes, **values):
    data = [(START + dt.timedelta(minutes=m), 200, 0.1, 0.2) for m in minutes]
    df = spark.createDataFrame(
        data, "predicted_at timestamp_ntz, status int, latency_s double, probability double"
    )
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def test_sliding_windows_cover_a_row_once_per_slide(spark):
    made = monitor.request_rate(log(spark, [10, 12]), "predicted_at").collect()
    found = {int((r.window_start - START).total_seconds() // 60): r.requests for r in made}
    assert found == {6: 1, 7: 1, 8: 2, 9: 2, 10: 2, 11: 1, 12: 1}


def test_window_must_fit_its_slide(spark):
    with pytest.raises(ValueError, match="multiple"):
        monitor.sliding(log(spark, [1]), "predicted_at", [], 5, 2)


def test_silence_is_a_row(spark):
    made = monitor.silent_windows(log(spark, [0, 60]), "predicted_at").collect()
    assert len(made) == 13 and sum(r.silent for r in made) == 9


def evaluations(spark, flags, step=5):
    data = [(START + dt.timedelta(minutes=step * i), bool(f)) for i, f in enumerate(flags)]
    return spark.createDataFrame(data, "window_start timestamp_ntz, breached boolean")


def test_a_condition_must_hold(spark):
    made = monitor.sustained(evaluations(spark, [1, 1, 1, 0, 1, 1, 1, 1, 0]), "breached", 5, 15)
    found = sorted((r.minutes, r.evaluations, r.fired) for r in made.collect())
    assert found == [(10, 3, False), (15, 4, True)]


def test_stretches_join_over_midnight(spark):
    made = monitor.sustained(evaluations(spark, [1] * 300), "breached", 10, 15).collect()
    assert [(r.evaluations, r.minutes) for r in made] != []
    whole = monitor.sustained(evaluations(spark, [1] * 600), "breached", 5, 15).collect()
    assert [(r.evaluations, r.minutes) for r in whole] == [(600, 2995)]


def test_four_rules_in_one_table(spark):
    quiet = log(spark, range(0, 60))
    calm = {r.rule: r for r in monitor.alert_rules(monitor.alert_evaluations(quiet)).collect()}
    assert {k: v.fired for k, v in calm.items()} == {
        "error_rate": 0, "latency": 0, "score_drift": 0, "no_traffic": 0,
    }
    bad = log(spark, range(0, 60), status=500, latency_s=3.0, probability=0.9)
    made = {r.rule: r.fired for r in monitor.alert_rules(monitor.alert_evaluations(bad)).collect()}
    assert made == {"error_rate": 1, "latency": 1, "score_drift": 1, "no_traffic": 0}
    gap = log(spark, [0, 1, 120])
    made = {r.rule: r.fired for r in monitor.alert_rules(monitor.alert_evaluations(gap)).collect()}
    assert made["no_traffic"] == 1 and made["error_rate"] == 0


def test_histogram_and_its_quantiles(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("p"))
    histogram = monitor.score_histogram(df, "p")
    found = {r.le: r.cumulative for r in histogram.collect()}
    assert found[0.0] == 1 and found[0.5] == 501 and found[1.0] == 1000 and len(found) == 12
    made = monitor.histogram_quantiles(histogram, {"p50": 0.5, "p90": 0.9}).first()
    assert made.p50 == pytest.approx(0.5, abs=0.01) and made.p90 == pytest.approx(0.9, abs=0.01)


def test_run_summary(spark):
    fine = monitor.slo_check(log(spark, range(100)), "predicted_at", "status", "latency_s").first()
    assert fine.passed and fine.requests == 100 and fine.throughput == pytest.approx(100 / (99 * 60))
    slow = log(spark, range(100), latency_s=2.0)
    assert not monitor.slo_check(slow, "predicted_at", "status", "latency_s").first().passed


def test_limits_are_the_published_ones():
    assert (catalog.MAX_DRIFTED_SHARE, catalog.DRIFT_LIMIT) == (0.3, 0.1)
    assert {r.name: (r.size, r.hold) for r in monitor.ALERTS} == {
        "error_rate": (5, 5), "latency": (5, 5), "score_drift": (15, 30), "no_traffic": (15, 15),
    }
