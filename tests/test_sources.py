import datetime as dt

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from riskflow.plans import standins
from riskflow.session import shared_folder
from riskflow.sources import log, store, summary, tables


@pytest.fixture(scope="module")
def served(spark):
    df = standins.prediction_log(spark, SMALL)
    return df.withColumn("features", F.from_json("features", "k int")).cache()


def test_log_round_trip_by_day(spark, served):
    path = shared_folder(spark)
    log.append_log(served, path)
    stored = log.read_log(spark, path)
    assert "k" in stored.columns and stored.count() == served.count()
    day = log.read_log(spark, path, dt.date(2024, 1, 5), dt.date(2024, 1, 5))
    want = served.where("to_date(predicted_at) = '2024-01-05'")
    assert rows(day.select("event_id")) == rows(want.select("event_id"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_compaction_keeps_rows(spark, served):
    path, target = shared_folder(spark), shared_folder(spark)
    for part in range(3):
        log.append_log(served.where(F.col("event_id") % 3 == part), path)
    log.compact_log(spark, path, target)
    before, after = spark.read.parquet(path), spark.read.parquet(target)
    assert rows(before.select("event_id", "status")) == rows(
        after.select("event_id", "status")
    )
    assert len(after.inputFiles()) < len(before.inputFiles())


def test_later_columns_are_null_in_earlier_rows(spark, served):
    path = shared_folder(spark)
    log.append_log(served.drop("caller").where("event_id % 2 = 0"), path)
    log.append_log(served.where("event_id % 2 = 1"), path)
    stored = log.read_log(spark, path)
    assert stored.where("caller is null").count() == served.where("event_id % 2 = 0").count()


def test_retention_drops_whole_days(spark, served):
    kept = log.retained(log.with_date(served), dt.date(2024, 2, 10), 30)
    assert kept.agg(F.min("date")).first()[0] == dt.date(2024, 1, 11)


def test_sinks_by_name(spark, served):
    path = shared_folder(spark)
    log.build_sink("files", path=path)(served)
    assert spark.read.parquet(path).count() == served.count()
    log.build_sink("none")(served)
    with pytest.raises(ValueError, match="unknown sink"):
        log.build_sink("tape")
    with pytest.raises(ValueError, match="path"):
        log.build_sink("files")


def test_a_failing_sink_fails_unless_told_otherwise(spark, served):
    broken = {"url": "jdbc:none:nowhere", "dbtable": "t"}
    with pytest.raises(Exception):  # noqa: B017, PT011 - whatever the driver raises
        log.build_sink("jdbc", **broken)(served)
    log.build_sink("jdbc", best_effort=True, **broken)(served)


def test_missing_table_is_a_typed_empty_frame(spark, tmp_path):
    empty = tables.declared(spark, str(tmp_path / "none"), tables.OUTCOMES)
    assert empty.schema == tables.OUTCOMES and empty.isEmpty()
    with pytest.raises(ValueError, match="no rows"):
        tables.non_empty(empty, "the store")


def test_unknown_source_is_an_error(spark):
    assert tables.dispatch("a", {"a": lambda: spark.range(1)}).count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        tables.dispatch("b", {"a": lambda: spark.range(1)})


def test_bucketed_tables_join_without_a_shuffle(spark):
    names = {"decided": standins.decisions(spark, SMALL), "reported": standins.outcomes(spark, SMALL)}
    try:
        for name, df in names.items():
            tables.store_bucketed(df, name, shared_folder(spark), "application_id", 4)
        left, right = (spark.table(n).hint("merge") for n in names)
        joined = left.join(right, "application_id")
        assert joined.count() == names["reported"].count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_newest_rows_without_a_global_sort(spark, served):
    made = tables.newest(served, "predicted_at", 5, tie="event_id")
    want = sorted((r.predicted_at, r.event_id) for r in served.collect())[-5:]
    assert sorted((r.predicted_at, r.event_id) for r in made.collect()) == want
    assert "TakeOrderedAndProject" in made._jdf.queryExecution().executedPlan().toString()


def test_summaries_round_trip_and_stay_small(spark, tmp_path):
    made = spark.createDataFrame([("a", 0.1 + 0.2, None), ("b", None, 3)], "name string, x double, n long")
    summary.write_summary(made, str(tmp_path / "s"))
    back = summary.read_summary(spark, str(tmp_path / "s"), made.schema)
    assert sorted(back.collect()) == sorted(made.collect())
    with pytest.raises(ValueError, match="at most"):
        summary.write_summary(spark.range(11), str(tmp_path / "t"), most=10)


def test_a_batch_meets_only_the_folders_of_its_keys(spark, tmp_path):
    rows = [(f"k{i}", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), i % 2) for i in range(300)]
    feed = spark.createDataFrame(rows, tables.OUTCOMES)
    kept = store.OutcomeStore(spark, str(tmp_path / "o"), buckets=16)
    assert kept.record(feed) == 300 and kept.record(feed) == 0
    one = spark.createDataFrame([("k7", *rows[0][1:]), ("new", *rows[0][1:])], tables.OUTCOMES)
    near = kept.touched(one)
    assert 0 < near.count() < 100 and near.filter("application_id = 'k7'").count() == 1
    assert "PartitionFilters: [key_bucket" in near._jdf.queryExecution().executedPlan().toString()
    assert kept.record(one) == 1 and kept.read().count() == 301
