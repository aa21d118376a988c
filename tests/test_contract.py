import pytest
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.operators import contract, reshape

BAD = [("age", 5), ("sex", 3), ("limit_bal", -100), ("pay_amt1", -1), ("pay_0", 99), ("age", None)]


@pytest.mark.parametrize(("column", "value"), BAD)
def test_bad_value_is_rejected(applications, column, value):
    bad = applications.withColumn(
        column, F.when(F.col("customer_id") == 7, F.lit(value)).otherwise(F.col(column))
    )
    good, rejected = contract.LABELLED.quarantine(bad)
    assert good.count() == 399
    row = rejected.first()
    assert row["customer_id"] == 7 and row["reasons"] == [column]
    with pytest.raises(contract.ContractBreach) as error:
        contract.LABELLED.enforce(bad)
    assert error.value.breaches == {column: 1}


def test_valid_frame_passes_and_bills_may_be_negative(applications):
    assert applications.where("bill_amt1 < 0").count() > 0
    assert contract.LABELLED.enforce(applications).count() == 400


def test_all_breaches_are_reported_at_once(applications):
    bad = applications.withColumns({"sex": F.lit(9), "age": F.lit(1)})
    with pytest.raises(contract.ContractBreach) as error:
        contract.LABELLED.enforce(bad)
    assert error.value.breaches == {"sex": 400, "age": 400}


def test_text_that_is_no_number_breaks_the_rule(applications):
    bad = applications.withColumn("age", F.lit("old"))
    counts = {r["rule"]: r["n_bad"] for r in contract.CLEANED.violations(bad).collect()}
    assert counts["age"] == 400 and counts["sex"] == 0


def test_cleaning_folds_codes_and_keeps_rows(applications):
    raw = applications.withColumns(
        {"education": F.col("customer_id") % 7, "marriage": F.col("customer_id") % 4}
    )
    cleaned = contract.clean(raw)
    assert cleaned.count() == 400
    assert {r[0] for r in cleaned.select("education").distinct().collect()} == {1, 2, 3, 4}
    assert {r[0] for r in cleaned.select("marriage").distinct().collect()} == {1, 2, 3}


def test_raw_contract_takes_codes_that_the_cleaned_one_refuses(applications):
    raw = applications.withColumn("education", F.lit(6))
    assert contract.RAW.quarantine(raw)[0].count() == 400
    assert contract.CLEANED.quarantine(raw)[0].count() == 0
    assert contract.CLEANED.quarantine(contract.clean(raw))[0].count() == 400


def test_optional_key_has_a_length(spark):
    rule = contract.Contract((contract.Rule("k", kind="string", max_length=3, optional=True),))
    df = spark.createDataFrame([("abc",), ("abcd",), (None,)], "k string")
    assert rule.quarantine(df)[1].count() == 1


def test_normalise_needs_the_target(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, b int")
    with pytest.raises(ValueError, match="missing"):
        contract.normalise(df, "target", "nothing")
    named = contract.normalise(df, "target", "b")
    assert dict(named.dtypes) == {"a": "int", "target": "tinyint"}


def test_protected_columns_end_at_the_projection(applications):
    numeric, codes = catalog.model_inputs()
    made = contract.project_features(applications, numeric, codes)
    assert not set(catalog.PROTECTED) & set(made.columns)
    assert len(catalog.model_inputs(())[0] + catalog.model_inputs(())[1]) == 23


def test_threshold_is_inclusive_and_missing_keys_are_filled(spark):
    df = spark.createDataFrame([(0.5, None), (0.49, "k")], "p double, k string")
    made = contract.filled_key(contract.decide(df, "p", 0.5), "k").collect()
    assert [r["prediction"] for r in made] == [1, 0]
    assert made[0]["k"] and made[1]["k"] == "k"


def test_unfold_then_refold_is_lossless(applications):
    events = reshape.unfold(applications, "customer_id")
    assert events.count() == 2400
    static = reshape.entities(applications, "customer_id", target=catalog.TARGET)
    again = reshape.refold(events, static, "customer_id").select(applications.columns)
    assert again.exceptAll(applications).count() == 0
    assert applications.exceptAll(again).count() == 0


def test_newest_month_reads_the_odd_status_column(applications):
    events = reshape.unfold(applications, "customer_id").where("statement_month = '2005-09-01'")
    both = events.join(applications, "customer_id")
    assert both.where("pay_status <> pay_0 or bill_amt <> bill_amt1").count() == 0


def test_flatten_names_fields_by_path(spark):
    df = spark.sql("select 1 as id, struct(2 as x, struct(3 as y) as deep) as features")
    flat = reshape.flatten(df)
    assert flat.columns == ["id", "features.x", "features.deep.y"]
    assert reshape.strip_prefix(flat).columns == ["id", "x", "deep.y"]
