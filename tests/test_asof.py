import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.operators import asof, reshape, views

KEY, MONTH = "customer_id", "statement_month"


def features():
    return views.event_features(MONTH)


@pytest.fixture(scope="module")
def events(applications):
    return reshape.unfold(applications, KEY).cache()


def at(events, keys, months, **options):
    asked = asof.spine(keys, KEY, months)
    return asof.point_in_time(events, asked, KEY, MONTH, features(), months, **options)


def test_one_month_more_per_date(events, applications):
    made = at(events, applications, catalog.MONTHS)
    counts = rows(made.groupBy("as_of").agg(F.min("observed_months"), F.max("observed_months")))
    assert [r[1:] for r in counts] == [(i, i) for i in range(1, 7)]


def test_future_rows_cannot_change_the_past(events, applications):
    cut = catalog.MONTHS[2]
    poisoned = events.withColumn(
        "bill_amt", F.when(F.col(MONTH) > F.lit(cut), 10**8).otherwise(F.col("bill_amt"))
    )
    assert rows(at(events, applications, [cut])) == rows(at(poisoned, applications, [cut]))


def test_wrong_join_differs_until_the_last_month(events, applications):
    asked = asof.spine(applications, KEY, catalog.MONTHS)
    right = at(events, applications, catalog.MONTHS)
    wrong = asof.latest(events, asked, KEY, MONTH, features())
    share = asof.disagreement(right, wrong, [KEY, "as_of"], views.EVENT_FEATURES, ["as_of"])
    found = dict((r["as_of"], r["corrupted_share"]) for r in share.collect())
    assert found[catalog.MONTHS[-1]] == 0
    assert all(found[m] > 0.3 for m in catalog.MONTHS[:-1])


def small(spark):
    data = [
        (1, dt.date(2005, 6, 1), 1, 400, 100),
        (1, dt.date(2005, 4, 1), 0, 100, 50),
        (1, dt.date(2005, 5, 1), 2, 200, 0),
        (2, dt.date(2005, 5, 1), None, None, 10),
        (2, dt.date(2005, 4, 1), 3, 0, 5),
    ]
    return spark.createDataFrame(
        data, f"{KEY} int, {MONTH} date, pay_status int, bill_amt int, pay_amt int"
    )


@pytest.mark.parametrize("running", [False, True])
def test_aggregates_by_hand(spark, running):
    events = small(spark)
    asked = asof.spine(events, KEY, [dt.date(2005, 3, 1), dt.date(2005, 6, 1)])
    dates = [dt.date(2005, 3, 1), dt.date(2005, 6, 1)]
    made = (
        asof.point_in_time_running(events, asked, KEY, MONTH, features())
        if running
        else asof.point_in_time(events, asked, KEY, MONTH, features(), dates)
    )
    found = {r[KEY]: r for r in made.collect()}
    assert len(found) == 2  # no event by March: the question is dropped
    one = found[1]
    assert (one.observed_months, one.pay_status_latest, one.pay_status_max) == (3, 1, 2)
    assert (one.months_delinquent, one.bill_latest, one.bill_trend) == (2, 400, 300)
    assert one.bill_mean == pytest.approx(700 / 3)
    assert one.payment_ratio_mean == pytest.approx((0.5 + 0 + 0.25) / 3)
    two = found[2]  # the newest value that is there; a bill of 0 divides as 1
    assert (two.pay_status_latest, two.bill_latest, two.observed_months) == (3, 0, 2)
    assert two.payment_ratio_mean == 5.0 and two.pay_amt_latest == 10


@pytest.mark.parametrize("running", [False, True])
def test_empty_questions_can_be_kept(spark, running):
    events, day = small(spark), dt.date(2005, 3, 1)
    asked = asof.spine(events, KEY, [day])
    made = (
        asof.point_in_time_running(events, asked, KEY, MONTH, features(), keep_empty=True)
        if running
        else asof.point_in_time(events, asked, KEY, MONTH, features(), [day], keep_empty=True)
    )
    assert rows(made.select("observed_months", "bill_latest")) == [(0, None), (0, None)]


def test_running_equals_slots_with_one_key_holding_a_third(spark):
    ids = spark.range(3000)
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    events = ids.select(
        key.alias(KEY),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") * 37 % 900).cast("int")).alias(MONTH),
        (F.col("id") % 9 - 2).cast("int").alias("pay_status"),
        (F.col("id") * 13 % 1000).alias("bill_amt"),
        (F.col("id") * 7 % 300).alias("pay_amt"),
        "id",
    )
    dates = [dt.date(2000, 3, 1), dt.date(2001, 1, 1), dt.date(2001, 9, 9)]
    asked = asof.spine(events, KEY, dates)
    slots = asof.point_in_time(events, asked, KEY, MONTH, features(), dates, tie="id")
    running = asof.point_in_time_running(events, asked, KEY, MONTH, features(), tie="id")

    def fixed(df):
        return rows(df.withColumn("payment_ratio_mean", F.round("payment_ratio_mean", 9)))

    assert fixed(slots) == fixed(running)
    assert slots.where(f"{KEY} = 0").count() == 3


def test_repeated_questions_collapse(events, applications):
    asked = asof.spine(applications, KEY, [catalog.MONTHS[1]])
    twice = asked.unionByName(asked)
    made = asof.point_in_time(events, twice, KEY, MONTH, features(), [catalog.MONTHS[1]])
    assert made.count() == 400 and made.agg(F.max("observed_months")).first()[0] == 2


def test_spine_refuses_the_outcome_month(applications):
    with pytest.raises(ValueError, match="not before"):
        asof.spine(applications, KEY, [catalog.OUTCOME_MONTH], outcome=catalog.OUTCOME_MONTH)


def test_row_level_spine_guard_fails_the_job(spark):
    day = dt.date(2020, 1, 1)
    ok = spark.createDataFrame([(1, day, dt.date(2020, 2, 1))], "k int, as_of date, due date")
    assert asof.checked_spine(ok, "as_of", "due").count() == 1
    late = ok.withColumn("due", F.col("as_of"))
    with pytest.raises(Exception, match="at or after its outcome"):
        asof.checked_spine(late, "as_of", "due").collect()


def test_spine_without_a_date_is_refused(events, applications):
    with pytest.raises(ValueError, match="spine lacks"):
        asof.point_in_time(
            events, applications.select(KEY), KEY, MONTH, features(), [catalog.MONTHS[0]]
        )


def test_utilisation_floor(spark):
    made = spark.createDataFrame([(1, 50)], f"{KEY} int, bill_latest int")
    static = spark.createDataFrame([(1, -3)], f"{KEY} int, limit_bal int")
    assert asof.attach_entities(made, static, KEY).first()["utilisation_latest"] == 50
