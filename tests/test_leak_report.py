import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.operators import asof, metrics, model
from riskflow.plans import QUERIES, features, models
from riskflow.session import shared_folder


@pytest.fixture(scope="module")
def tables(spark):
    """400 customers with ten orders each, over eight years."""
    sf = shared_folder(spark)
    spark.range(400).select(
        F.col("id").alias("c_custkey"),
        ((F.col("id") * 37 % 9_000) + 0.5).alias("c_acctbal"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"),
    ).coalesce(1).write.parquet(f"{sf}/customer.parquet")
    day = F.lit(dt.datetime(1995, 1, 1)).cast("timestamp_ntz")
    mix = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    spark.range(4_000).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 400).alias("o_custkey"),
        (1_000 + mix / 4).alias("o_totalprice"),
        (day + F.make_dt_interval((mix % 2_500).cast("int"))).alias("o_orderdate"),
        F.concat((1 + mix % 5).cast("string"), F.lit("-X")).alias("o_orderpriority"),
    ).coalesce(1).write.parquet(f"{sf}/orders.parquet")
    return sf


def test_one_leaky_model_serves_every_month(spark, tables, monkeypatch):
    """Seven fits, not twelve; the numbers are those of a leaky model per month."""
    fits, train = [], model.train
    monkeypatch.setattr(model, "train", lambda *args: fits.append(1) or train(*args))
    made = {r["as_of"]: r for r in QUERIES["leak_report"](spark, tables).collect()}
    assert len(fits) == 1 + len(catalog.MONTHS) and sorted(made) == sorted(catalog.MONTHS)
    assert len({r["leaked_reported"] for r in made.values()}) == 1

    apps = models.records(spark, tables)
    names = [*models.views.EVENT_FEATURES, "limit_bal", "utilisation_latest"]
    joined = [f.join(apps.select(models.KEY, models.LABEL), models.KEY).cache() for f in features.both_joins(apps)]
    for month in (catalog.MONTHS[1], catalog.MONTHS[-1]):
        (train_right, right), (train_wrong, wrong) = (models.parts(f.where(F.col("as_of") == F.lit(month))) for f in joined)
        fit = models.fit_logistic(names, [])
        honest, leaked = fit(train_right), fit(train_wrong)
        for variant, scorer, rows in (("leaked_reported", leaked, wrong), ("leaked_in_production", leaked, right), ("honest", honest, right)):
            want = metrics.ranking(scorer.score(rows), models.LABEL, "probability").first()["pr_auc"]
            assert made[month][variant] == pytest.approx(want, abs=1e-6), variant


def test_the_join_that_ignores_time_is_the_same_every_month(spark, tables):
    apps = models.records(spark, tables)
    asked = asof.spine(apps, models.KEY, catalog.MONTHS)
    wrong = asof.latest(features.reshape.unfold(apps, models.KEY), asked, models.KEY, features.MONTH, features.features())
    assert wrong.count() == 400 * len(catalog.MONTHS) and wrong.drop("as_of").distinct().count() == 400
