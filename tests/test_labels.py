import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskflow.functions.scalar import hash_uniform
from riskflow.operators import labels, metrics, sampling
from riskflow.sources.store import NullStore, OutcomeStore, build_store

START = dt.datetime(2024, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def decisions(spark):
    data = [(f"A{i}", day(i), 0.05 + 0.18 * i, int(i >= 4)) for i in range(6)]
    return spark.createDataFrame(
        data,
        "application_id string, predicted_at timestamp_ntz, probability double, prediction int",
    )


@pytest.fixture(scope="module")
def outcomes(spark):
    data = [(f"A{i}", day(i + 30), day(i + 30 + 10 * i), i % 2) for i in range(5)]
    return spark.createDataFrame(
        data, "application_id string, outcome_at timestamp_ntz, observed_at timestamp_ntz, label int"
    )


def keys(df):
    return sorted(r["application_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("as_of", "expected"), [(29, []), (30, ["A0"]), (40, ["A0"]), (41, ["A0", "A1"]), (500, 5)]
)
def test_both_gates_are_inclusive(decisions, outcomes, as_of, expected):
    found = keys(labels.join_labels(decisions, outcomes, day(as_of)))
    assert len(found) == expected if isinstance(expected, int) else found == expected


@pytest.mark.parametrize("as_of", [10, 31, 45, 60, 90, 500])
def test_counts_add_up(decisions, outcomes, as_of):
    c = labels.join_counts(decisions, outcomes, day(as_of)).first()
    assert c.censored + c.pending + c.observed == c.matured <= c.total == 6
    assert c.observed == labels.join_labels(decisions, outcomes, day(as_of)).count()
    assert c.coverage == (c.observed / c.matured if c.matured else 0)


def test_unkeyed_decisions_count_but_never_match(decisions, outcomes):
    free = decisions.withColumn("application_id", F.lit(None).cast("string"))
    c = labels.join_counts(decisions.unionByName(free), outcomes, day(500)).first()
    assert (c.total, c.matured, c.observed, c.pending, c.censored) == (12, 12, 5, 4, 3)
    assert labels.unlabelled(decisions.unionByName(free), outcomes, day(500)).count() == 7


def test_naive_join_finds_strictly_more(decisions, outcomes):
    honest = labels.join_labels(decisions, outcomes, day(45)).count()
    assert labels.join_ignoring_time(decisions, outcomes).count() > honest


def test_decisions_without_a_key_column_are_refused(decisions, outcomes):
    with pytest.raises(ValueError, match="decisions lacks"):
        labels.join_labels(decisions.drop("application_id"), outcomes, day(1))


def test_store_keeps_the_first_report(spark, outcomes, tmp_path):
    store = build_store(spark, "files", str(tmp_path / "store"))
    assert store.read().count() == 0 and store.read().columns == outcomes.columns
    again = outcomes.withColumns(
        {"label": 1 - F.col("label"), "observed_at": F.col("observed_at") + F.expr("interval 9 day")}
    )
    assert store.record(again.unionByName(outcomes)) == 5
    assert store.record(again) == 0
    assert rows(store.read()) == rows(outcomes)
    assert store.read(day(41)).count() == 2


def test_other_stores(spark, outcomes):
    assert isinstance(build_store(spark, "none"), NullStore)
    assert NullStore(spark).record(outcomes) == 0 and NullStore(spark).read().count() == 0
    with pytest.raises(ValueError, match="unknown"):
        build_store(spark, "tape")
    with pytest.raises(ValueError, match="path"):
        build_store(spark, "files")
    assert isinstance(build_store(spark, "files", "/x"), OutcomeStore)


def test_curve_rises_with_time(decisions, outcomes):
    curve = labels.maturity_curve(decisions, outcomes, [5, 30, 45, 60, 400], bounds=[0.5])
    found = sorted(curve.collect(), key=lambda r: r.days)
    assert [r.days for r in found] == [30, 45, 60, 400]  # no label by day 5
    assert [r.labels for r in found] == [1, 2, 3, 5]
    assert found[0].observed_pr_auc is None  # one class only
    assert found[-1].coverage == pytest.approx(5 / 6)


def test_holdout_takes_only_declined_rows(spark):
    df = spark.range(5000).withColumn("prediction", (F.col("id") % 2).cast("int"))
    seen = sampling.observe(df, "id", rate=0.1)
    assert seen.where("prediction = 0 and (not observable or holdout)").count() == 0
    share = seen.where("prediction = 1").agg(F.avg(F.col("holdout").cast("int"))).first()[0]
    assert 0.07 < share < 0.13


def test_censored_rows_have_no_report(decisions):
    frame = labels.censoring_frame(decisions, F.lit(12.5), rate=0.0001)
    assert rows(frame.where("observed_at is null").select("application_id")) == [("A4",), ("A5",)]
    first = frame.where("application_id = 'A0'").first()
    assert first.observed_at == day(42.5) and first.matures_at == day(30)


def population(spark):
    df = spark.range(20_000).withColumn("probability", hash_uniform("id", 5))
    return df.withColumns(
        {
            "label": (hash_uniform("id", 6) < F.col("probability")).cast("int"),
            "prediction": (F.col("probability") >= 0.3).cast("int"),
        }
    )


def test_weights_recover_the_population_rate(spark):
    truth = population(spark)
    seen = sampling.observe(truth, "id", rate=0.1).where("observable")
    made = {r.estimate: r for r in metrics.compare_estimates(seen, 0.1, truth).collect()}
    full, ipw, observed = made["full"], made["ipw"], made["observed"]
    assert abs(ipw.positive_rate - full.positive_rate) < 0.03
    assert abs(ipw.pr_auc - full.pr_auc) < abs(observed.pr_auc - full.pr_auc)
    assert ipw.effective_rows < ipw.rows and full.rows == 20_000


@pytest.mark.parametrize("rate", [0.0, -0.1, 1.5])
def test_no_holdout_no_correction(rate):
    with pytest.raises(ValueError, match="not in"):
        metrics.selection_probability(F.lit(1), rate)


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    shares = {"current": 0.25, "test": 0.2}
    made = sampling.stratified_split(df, "id", "y", shares, "train")
    counts = {(r.cohort, r.y): r["count"] for r in made.groupBy("cohort", "y").count().collect()}
    assert counts == {
        ("current", 0): 200, ("current", 1): 50, ("test", 0): 120, ("test", 1): 30,
        ("train", 0): 480, ("train", 1): 120,
    }
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sampling.stratified_split(df.repartition(9), "id", "y", shares, "train")
        assert rows(again) == rows(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_folds_are_even_in_every_stratum(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    made = sampling.kfold(df, "id", "y", 5).groupBy("y", "fold").count()
    assert {(r.y, r["count"]) for r in made.collect()} == {(0, 90), (1, 10)}
