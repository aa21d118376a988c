import datetime as dt
import random

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from riskflow.operators import drift, monitor, reshape, sketches
from riskflow.plans import standins
from riskflow.session import shared_folder
from riskflow.streaming import live
from riskflow.streaming.runs import updated


def ranks(spark, n=60_000):
    """A busy hour of 60,000 values that are their own rank, shuffled by a hash."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.xxhash64("id"), F.lit(3600)))
    return spark.range(1, n + 1).select(F.col("id").cast("double").alias("x"), at.alias("at"))


@pytest.mark.parametrize("entries", [200, 800])
def test_merged_quantiles_stay_within_the_error(spark, entries):
    panes = (
        ranks(spark)
        .groupBy(monitor.pane_start("at", 5).alias("window_start"))
        .agg(*sketches.quantile_parts("x", entries))
    )
    assert panes.count() == 12
    probs = {"low": 0.05, "mid": 0.5, "high": 0.99}
    made = sketches.merged_quantiles(panes, probs, 5, 60, entries=entries).collect()
    assert [r["n"] for r in made] == [60_000]
    for name, q in probs.items():
        assert abs(made[0][name] / 60_000 - q) <= sketches.rank_error(entries)
    assert sketches.rank_error(800) < sketches.rank_error(200) < 0.05


def test_sliding_windows_of_small_panes_are_exact(spark):
    log = standins.prediction_log(spark, SMALL)
    panes = log.groupBy(monitor.pane_start("predicted_at", 60).alias("window_start")).agg(
        *sketches.quantile_parts("latency_s")
    )
    made = sketches.merged_quantiles(panes, {"p95": 0.95}, 60, 180, 60)
    found = {r["window_start"]: (r["n"], r["p95"]) for r in made.collect()}
    want = {}
    for at, value in log.select("predicted_at", "latency_s").collect():
        hour = at.replace(minute=0, second=0, microsecond=0)
        for back in range(3):
            want.setdefault(hour - dt.timedelta(hours=back), []).append(value)
    assert found == {w: (len(v), sorted(v)[-(-len(v) * 95 // 100) - 1]) for w, v in want.items()}
    with pytest.raises(ValueError):
        sketches.merged_quantiles(panes, {}, 60, 100)


def test_nulls_and_nan_have_no_rank(spark):
    at = dt.datetime(2024, 1, 1)
    given = [(at, 1.0), (at, None), (at, float("nan")), (at + dt.timedelta(hours=1), None)]
    df = spark.createDataFrame(given, "at timestamp_ntz, x double")
    panes = df.groupBy(F.col("at").alias("window_start")).agg(*sketches.quantile_parts("x"))
    made = sketches.merged_quantiles(panes, {"mid": 0.5}, 60, 60)
    assert rows(made.select("n", "mid")) == [(0, None), (1, 1.0)]
    assert sketches.merged_quantiles(panes.limit(0), {"mid": 0.5}, 60, 60).count() == 0


def test_panes_of_a_stream_in_many_batches_are_those_of_the_table(spark):
    log = standins.prediction_log(spark, SMALL)
    path = shared_folder(spark)
    log.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    panes = updated(live.quantile_panes(stream, "predicted_at", "latency_s", delay="60 days"), ["window_start"])
    made = sketches.merged_quantiles(panes, {"p95": 0.95}, 60, 1440)
    exact = monitor.window_quantiles(log, "predicted_at", "latency_s", {"p95": 0.95}, size=1440)
    assert rows(made.select("window_start", "n", "p95")) == rows(exact)


def members(spark, spans):
    made = spark.createDataFrame([(s, k) for s, keys in spans.items() for k in keys], "day int, who long")
    return sketches.member_sketches(made, F.col("day"), "who", bits=10)


def pair(spark, old, new):
    found = members(spark, {1: old, 2: new})
    return found.agg(
        sketches.union_of(found, F.col("span") == 1, "a", 10), sketches.union_of(found, F.col("span") == 2, "b", 10)
    )


def test_small_sketches_count_exactly(spark):
    made = sketches.changes(pair(spark, [1, 2, 3, 3, None], [3, 4]), "a", "b")
    assert rows(made) == [(3, 2, 1, 1, 2)]
    empty = spark.sql("SELECT CAST(NULL AS BINARY) AS a, CAST(NULL AS BINARY) AS b")
    assert rows(sketches.changes(empty, "a", "b")) == [(0, 0, 0, 0, 0)]
    half = pair(spark, [7, 8], []).select(F.lit(None).cast("binary").alias("a"), F.col("a").alias("b"))
    assert rows(sketches.changes(half, "a", "b")) == [(0, 2, 0, 2, 0)]


def test_large_sketches_stay_within_the_bound(spark):
    old, new = range(30_000), range(20_000, 50_000)
    made = sketches.changes(pair(spark, old, new), "a", "b").first()
    slack = 4 * 50_000 / 2**5  # four times the union over the root of 1,024 entries
    want = {"before": 30_000, "after": 30_000, "kept": 10_000, "came": 20_000, "went": 20_000}
    assert all(abs(made[c] - n) <= slack for c, n in want.items())
    assert made["before"] != 30_000  # estimates, not counts


def test_any_two_spans_of_the_cube_equal_the_index_of_their_rows(spark):
    source = random.Random(1)
    day = dt.date(2024, 1, 1)
    given = [(day + dt.timedelta(days=source.choice([0, 1, 2, 5, 6, 9])), source.random()) for _ in range(500)]
    given += [(day, None), (None, 0.5), (day, float("nan"))]
    df = spark.createDataFrame(given, "day date, x double")
    edges = [0.2, 0.5, 0.9]
    cube = drift.bin_cube(df, "day", "x", edges)
    assert cube.count() == 10 * 4

    def at(i):
        return day + dt.timedelta(days=i)

    pairs = [(0, 1, 2, 6), (0, 0, 9, 9), (-5, 2, 5, 40), (0, 9, 0, 9), (0, 1, 3, 4), (0, 1, 20, 30)]
    spans = spark.createDataFrame([tuple(map(at, p)) for p in pairs], "r_first date, r_last date, k_first date, k_last date")
    got = {tuple((d - day).days for d in r[:4]): r for r in drift.psi_between(cube, spans).collect()}
    for p in pairs:
        r = df.where(F.col("day").between(at(p[0]), at(p[1])) & F.col("x").isNotNull() & ~F.isnan("x")).select("x")
        k = df.where(F.col("day").between(at(p[2]), at(p[3])) & F.col("x").isNotNull() & ~F.isnan("x")).select("x")
        assert (got[p]["reference_rows"], got[p]["current_rows"]) == (r.count(), k.count())
        want = drift.psi(drift.both(r, k, ["x"]), "x", edges).first()[0] if k.count() else None
        assert got[p]["psi"] == (pytest.approx(want) if want is not None else None)


def test_a_group_is_held_against_its_own_cube(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [(g, day + dt.timedelta(days=d), x) for g, d, x in [("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.1), ("b", 1, 0.1)]],
        "g string, day date, x double",
    )
    cube = drift.bin_cube(df, "day", "x", [0.5], by=["g"])
    next_day = day + dt.timedelta(days=1)
    spans = spark.createDataFrame([(g, day, day, next_day, next_day) for g in "ab"],
                                  "g string, r_first date, r_last date, k_first date, k_last date")
    got = {r["g"]: r["psi"] for r in drift.psi_between(cube, spans, by=["g"]).collect()}
    assert got["b"] == 0.0 and got["a"] is not None
    assert drift.bin_cube(df.limit(0), "day", "x", [0.5]).count() == 0


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, doc string")


def test_documents_of_unknown_shape(spark):
    df = documents(
        spark, '{"k": 1, "b": true}', '{"k": 2.5, "s": "x"}', '{"s": 3, "o": {"a": [1]}, "n": null}',
        None, "[1]", "{bad", '{"a b\'\\"": 7}', "{}", '{"Id": 9}',
    )
    made = reshape.discover_documents(df, "doc")
    types = dict(made.dtypes)
    assert types == {"id": "bigint", "doc.Id": "bigint", "a b'\"": "bigint", "b": "boolean",
                     "k": "double", "n": "string", "o": "string", "s": "string"}
    found = {r["id"]: {c: v for c, v in r.asDict().items() if v is not None and c != "id"} for r in made.collect()}
    assert found == {0: {"k": 1.0, "b": True}, 1: {"k": 2.5, "s": "x"}, 2: {"s": "3", "o": '{"a":[1]}'},
                     3: {}, 4: {}, 5: {}, 6: {"a b'\"": 7}, 7: {}, 8: {"doc.Id": 9}}
    assert reshape.discover_documents(df.limit(0), "doc").columns == ["id"]


def test_document_keys_are_counted_by_type(spark):
    df = documents(spark, '{"k": 1}', '{"k": 2}', '{"k": "2"}', "{}")
    assert rows(reshape.document_keys(df, "doc")) == [("k", "BIGINT", 2), ("k", "STRING", 1)]
