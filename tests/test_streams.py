import datetime as dt

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.operators import contract, labels, model, monitor
from riskflow.plans import standins
from riskflow.session import shared_folder
from riskflow.sources.store import OutcomeStore
from riskflow.streaming import live
from riskflow.streaming.runs import appended, finish, table_stream, updated, wall_clock


def streamed(spark, df, files=1):
    """A table of some files as a stream that takes one file per batch."""
    path = shared_folder(spark)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_in_many_batches_equal_the_batch_query(spark):
    log = standins.prediction_log(spark, SMALL)
    stream = live.windows(
        streamed(spark, log, 4),
        "predicted_at",
        "5 minutes",
        [F.count(F.lit(1)).alias("requests")],
        slide="1 minute",
        delay="60 days",
    )
    made = wall_clock(updated(stream, ["window_start"]), "window_start")
    batch = monitor.request_rate(log, "predicted_at").select("window_start", "requests")
    assert rows(made) == rows(batch)


def test_a_folder_and_a_file_stream_alike(spark):
    single = table_stream(spark, SMALL, "events")
    root = shared_folder(spark)
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{root}/events.parquet")
    folder = table_stream(spark, root, "events")
    assert rows(appended(single.select("event_id"))) == rows(appended(folder.select("event_id")))


def test_scoring_uses_the_trained_pipeline(spark, applications):
    numeric, codes = catalog.model_inputs()
    scorer = model.train(applications, catalog.TARGET, numeric, codes, model.logistic)
    bad = F.when(F.col("customer_id") == 3, F.lit(5)).otherwise(F.col("age"))
    source = applications.withColumn("age", bad)

    def score(df):
        return scorer.score(contract.clean(df))

    stream = live.score_stream(
        streamed(spark, source, 3), contract.RAW, score, "probability", 0.3, "v1"
    )
    root = shared_folder(spark)
    live.log_scored(stream, f"{root}/log", f"{root}/checkpoint")
    stored = spark.read.schema(stream.schema).parquet(f"{root}/log")
    rejected = stored.where("not accepted").collect()
    assert [(r.customer_id, r.reasons, r.probability) for r in rejected] == [(3, ["age"], None)]
    batch = scorer.score(applications.where("customer_id <> 3"))
    both = stored.where("accepted").select("customer_id", F.col("probability").alias("p"), "prediction")
    off = both.join(batch, "customer_id").where(
        "abs(p - probability) > 1e-9 or prediction <> int(probability >= 0.3)"
    )
    assert both.count() == 399 and off.count() == 0
    live.log_scored(stream, f"{root}/log", f"{root}/checkpoint")  # nothing new: nothing added
    assert spark.read.parquet(f"{root}/log").count() == 400


def test_replayed_outcomes_change_nothing(spark):
    feed = standins.restated_feed(spark, SMALL)
    root = shared_folder(spark)
    store = OutcomeStore(spark, f"{root}/store")
    for run in ("first", "again"):
        live.ingest_outcomes(streamed(spark, feed.coalesce(1)), store, f"{root}/{run}")
    assert rows(store.read()) == rows(standins.outcomes(spark, SMALL))


def test_repeats_drop_within_the_watermark(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("a", start), ("a", start + dt.timedelta(hours=1)), ("b", start)]
    df = spark.createDataFrame(data, "k string, at timestamp_ntz")
    made = appended(live.distinct_feed(streamed(spark, df), "k", "at", "1 day"))
    assert rows(made.select("k")) == [("a",), ("b",)]


def test_silence_is_the_end_of_a_session(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("a", start + dt.timedelta(minutes=m)) for m in (0, 10, 60, 600)]
    df = spark.createDataFrame(data, "caller string, at timestamp_ntz")
    made = wall_clock(appended(live.silences(streamed(spark, df), "at", "caller")), "silent_since")
    assert rows(made) == [
        ("a", start + dt.timedelta(minutes=25), 2),
        ("a", start + dt.timedelta(minutes=75), 1),
    ]


def test_outer_label_stream_gives_up_after_the_horizon(spark):
    start = dt.datetime(2024, 1, 1)
    decisions = spark.createDataFrame(
        [("a", start), ("b", start), ("z", start + dt.timedelta(days=900))],
        "application_id string, predicted_at timestamp_ntz",
    )
    outcomes = spark.createDataFrame(
        [("a", start + dt.timedelta(days=40), 1), ("z", start + dt.timedelta(days=940), 0)],
        "application_id string, observed_at timestamp_ntz, label int",
    )
    stream = live.label_stream(
        streamed(spark, decisions), streamed(spark, outcomes), horizon_days=100, how="leftOuter"
    )
    found = rows(appended(stream).select("application_id", "label"))
    assert found == [("a", 1), ("b", None), ("z", 0)]


def test_stream_join_equals_the_batch_join(spark):
    decisions = standins.decisions(spark, SMALL)
    outcomes = standins.outcomes(spark, SMALL)
    stream = live.label_stream(
        streamed(spark, decisions, 2), streamed(spark, outcomes.drop("outcome_at"), 2),
        horizon_days=4000, delay="4000 days",
    )
    batch = labels.join_ignoring_time(decisions, outcomes).drop("outcome_at", "matures_at")
    made = wall_clock(appended(stream), "predicted_at", "observed_at").select(batch.columns)
    assert rows(made) == rows(batch)


@pytest.mark.parametrize("files", [1, 5])
def test_alert_state_survives_batches(spark, files):
    start = dt.datetime(2024, 1, 1)
    flags = [0, 1, 1, 1, 1, 1, 0, 0, 1, 1, 0]
    root = shared_folder(spark)
    size = -(-len(flags) // files)
    for i in range(0, len(flags), size):  # files arrive in time order
        data = [
            ("r", start + dt.timedelta(minutes=5 * j), bool(flags[j]), 15)
            for j in range(i, min(i + size, len(flags)))
        ]
        df = spark.createDataFrame(
            data, "rule string, window_start timestamp_ntz, breached boolean, hold int"
        )
        df.coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)
    made = rows(wall_clock(appended(live.alert_states(stream)), "at"))
    at = {state: (when - start).total_seconds() / 60 for _, when, state in made}
    assert len(made) == 2 and at == {"firing": 20, "resolved": 30}


def test_alerts_without_evaluations_have_no_data(spark):
    """A gap between batches, one inside a batch, and the end of the feed."""
    start = dt.datetime(2024, 1, 1)
    minutes = [[0, 5, 10, 15, 20], [200, 205, 210, 215, 500, 505]]
    root = shared_folder(spark)
    for part in minutes:
        data = [("r", c, start + dt.timedelta(minutes=m), True, 15) for m in part for c in ("a", "b") if c == "a" or m < 100]
        df = spark.createDataFrame(data, "rule string, caller string, window_start timestamp_ntz, breached boolean, hold int")
        df.coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)
    made = appended(live.alert_states(live.with_end(stream, "window_start"), ["rule", "caller"], patience=60))
    found = sorted((c, (at - start).total_seconds() / 60, state) for _, c, at, state in rows(wall_clock(made, "at")))
    assert found == [
        ("a", 15, "firing"), ("a", 80, "no_data"), ("a", 215, "firing"), ("a", 275, "no_data"), ("a", 565, "no_data"),
        ("b", 15, "firing"), ("b", 80, "no_data"),
    ]


def test_silences_begin_by_timer_and_end_with_the_next_row(spark):
    start = dt.datetime(2024, 1, 1)
    root = shared_folder(spark)
    for part in ([0, 10, 25, 41], [100, 101, 300]):
        data = [("a", start + dt.timedelta(minutes=m, microseconds=7)) for m in part]
        df = spark.createDataFrame(data, "caller string, at timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(root)
    for files in (1, 10):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(root)
        made = wall_clock(appended(live.silence_states(live.with_end(stream, "at"), "at", ["caller"])), "at")
        found = sorted(((at - start) / dt.timedelta(minutes=1), state) for _, at, state in rows(made))
        assert [(round(m, 3), s) for m, s in found] == [(40, "silent"), (41, "back"), (56, "silent"), (100, "back"), (116, "silent"), (300, "back"), (315, "silent")]


def test_failed_batch_is_repeated_in_place(spark):
    stream = streamed(spark, spark.range(10), 2)
    root = shared_folder(spark)

    def half(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/rows/b={number}")
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        finish(stream, half, f"{root}/checkpoint")
    finish(
        stream,
        lambda b, n: b.write.mode("overwrite").parquet(f"{root}/rows/b={n}"),
        f"{root}/checkpoint",
    )
    assert rows(spark.read.parquet(f"{root}/rows").select("id")) == [(i,) for i in range(10)]
