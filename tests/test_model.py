import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.operators import metrics, model, sampling, trees
from riskflow.session import shared_folder

LABEL, KEY = catalog.TARGET, "customer_id"
NUMERIC, CODES = catalog.model_inputs()


@pytest.fixture(scope="module")
def linear(applications):
    return model.train(applications, LABEL, NUMERIC, CODES, model.logistic)


@pytest.fixture(scope="module")
def boosted(applications):
    return model.train(applications, LABEL, NUMERIC, CODES, model.boosted(6, 3, 0.2))


def test_signal_is_learnt(applications, linear):
    made = metrics.ranking(linear.score(applications), LABEL, "probability").first()
    assert made.roc_auc > 0.7


def test_unknown_code_is_all_zeros(applications, linear):
    odd = applications.limit(1).withColumn("education", F.lit(77))
    made = linear.encoding.transformer().transform(odd)
    names = [n for n, source, _ in linear.encoding.columns() if source == "education"]
    assert len(names) == 3 and list(made.select(*names).first()) == [0.0, 0.0, 0.0]
    assert linear.score(odd).first().probability > 0


def test_other_columns_do_not_reach_the_model(applications, linear):
    noisy = applications.withColumns({"surprise": F.rand(1), "sex": F.lit(9), "age": F.lit(99)})
    a = rows(linear.score(applications).select(KEY, "probability"))
    assert rows(linear.score(noisy).select(KEY, "probability")) == a
    assert not {source for _, source, _ in linear.encoding.columns()} & set(catalog.PROTECTED)


def test_scaled_columns_have_mean_0_and_deviation_1(applications):
    encoding = model.fit_encoding(applications.withColumn("flat", F.lit(4)), ["age", "flat"], [])
    made = encoding.transformer().transform(applications.withColumn("flat", F.lit(4)))
    got = made.agg(F.avg("std_age"), F.stddev_pop("std_age"), F.max("std_flat")).first()
    assert tuple(got) == pytest.approx((0, 1, 0), abs=1e-9)


def test_identifiers_are_no_categories(spark):
    df = spark.range(5000)
    with pytest.raises(ValueError, match="too many codes"):
        model.fit_encoding(df, [], ["id"])


def test_cutoff_and_schema_travel_with_the_model(spark, applications, linear):
    path = shared_folder(spark)
    inputs = applications.select(*NUMERIC, *CODES).schema
    model.Scorer(linear.pipeline, linear.encoding, 0.17).save(spark, path, inputs)
    loaded, schema = model.load_scorer(spark, path)
    assert loaded.cutoff == 0.17 and loaded.encoding.columns() == linear.encoding.columns()
    assert rows(loaded.score(applications)) == rows(linear.score(applications))
    made = loaded.decide(applications)
    assert made.where("prediction <> int(probability >= 0.17)").count() == 0
    model.check_schema(applications, schema)
    with pytest.raises(ValueError, match="limit_bal"):
        model.check_schema(applications.withColumn("limit_bal", F.lit("x")), schema)


def test_every_row_is_scored_out_of_fold(applications):
    folds = model.stored_folds(applications, KEY, LABEL, 3)
    fit = lambda df: model.train(df, LABEL, ["limit_bal"], ["pay_0"], model.logistic)
    oof = model.out_of_fold(folds, fit, 3)
    assert rows(oof.select(KEY)) == rows(applications.select(KEY))
    choice = model.tuned_cutoff(oof, LABEL).first()
    assert choice.expected_cost <= choice.cost_at_half



def test_search_reports_the_lead_over_the_baseline(applications):
    def fit(columns):
        return lambda df: model.train(df, LABEL, columns, [], model.logistic)

    found = model.search(
        applications, KEY, LABEL, {"noise": fit(["age"]), "signal": fit(["pay_0"])}, "noise", k=2
    )
    made = {r.candidate: r for r in found.collect()}
    assert made["noise"].improvement == 0 and not made["noise"].best
    assert made["signal"].best and made["signal"].improvement > 0.1


def total(contributions="contributions"):
    return F.aggregate(contributions, F.lit(0.0), lambda a, r: a + r.contribution)


def test_tree_reasons_add_up(applications, boosted):
    made = trees.tree_contributions(boosted, applications, [KEY])
    off = made.where(F.abs(F.col("base") + total() - F.col("margin")) > 1e-6)
    assert made.count() == 400 and off.count() == 0
    scored = boosted.score(applications).join(made, KEY)
    logit = F.log(F.col("probability") / (1 - F.col("probability")))
    assert scored.where(F.abs(logit - F.col("margin")) > 1e-6).count() == 0


def shapley(leaves, x, feature, features):
    """Straight from the definition: over all coalitions."""
    from itertools import combinations
    from math import factorial

    def value(inside):
        total = 0.0
        for leaf in leaves:
            product = leaf.value
            for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True):
                product *= float(lo < x[f] <= hi) if f in inside else share
            total += product
        return total

    others, m = [f for f in features if f != feature], len(features)
    out = 0.0
    for size in range(m):
        w = factorial(size) * factorial(m - size - 1) / factorial(m)
        for inside in combinations(others, size):
            out += w * (value({*inside, feature}) - value(set(inside)))
    return out


def test_tree_reasons_equal_the_definition(applications):
    import numpy as np

    small = model.train(
        applications, LABEL, ["pay_0", "limit_bal", "age"], ["sex"], model.boosted(3, 3, 0.3)
    )
    leaves = trees.leaves_of(small.model)
    n = len(small.encoding.columns())
    x = np.array([[0.3, -1.0, 0.7, 1.0], [1.5, 0.2, -0.4, 0.0]])
    made = trees.attribute(x, leaves, np.arange(n), n)
    for row, got in zip(x, made, strict=True):
        want = [shapley(leaves, row, f, range(n)) for f in range(n)]
        assert got[:n] == pytest.approx(want)


def test_linear_reasons_add_up_and_are_ordered(applications, linear):
    means = model.encoded_means(linear, applications)
    made = model.linear_contributions(linear, means)(linear.decide(applications))
    base = linear.model.intercept + sum(
        w * means[n]
        for w, (n, _, _) in zip(linear.model.coefficients, linear.encoding.columns(), strict=True)
    )
    logit = F.log(F.col("probability") / (1 - F.col("probability")))
    assert made.where(F.abs(logit - base - total()) > 1e-6).count() == 0
    told = model.reasons(made, "contributions", F.col("prediction") == 1).collect()
    assert {r.prediction for r in told} == {0, 1}
    for r in told:
        amounts = [x.contribution for x in r.reasons]
        if r.prediction == 1:
            assert all(a >= 0 for a in amounts) and amounts == sorted(amounts, reverse=True)
            assert all(x.direction == "increased_risk" for x in r.reasons)
        else:
            assert [abs(a) for a in amounts] == sorted(map(abs, amounts), reverse=True)
        assert len(r.reasons) <= catalog.TOP_REASONS
        assert not {x.feature for x in r.reasons} & set(catalog.PROTECTED)
        assert all(x.description == catalog.DESCRIPTIONS[x.feature] for x in r.reasons)


def test_protected_value_does_not_change_the_score(applications, linear, boosted):
    variants = model.counterfactuals(applications, "sex", [1, 2])
    assert variants.count() == 800
    for scorer in (linear, boosted):
        found = model.invariance(scorer.score(variants), KEY).first()
        assert (found["keys"], found.changed) == (400, 0)
    seen = model.train(applications, LABEL, [], ["sex"], model.logistic)
    assert model.invariance(seen.score(variants), KEY).first().changed == 400


def test_loose_split_is_about_right_and_repeatable(applications):
    made = sampling.loose_split(applications, KEY, {"current": 0.25, "test": 0.2}, "train")
    share = {r.cohort: r["count"] / 400 for r in made.groupBy("cohort").count().collect()}
    assert share["current"] == pytest.approx(0.25, abs=0.07)
    assert share["test"] == pytest.approx(0.15, abs=0.07)


def test_codes_are_counted_exactly(spark):
    df = spark.range(3_000).select(
        F.col("id").alias("x"),
        (F.col("id") % 1_000).cast("int").alias("full"),
        F.when(F.col("id") > 0, (F.col("id") % 1_001).cast("string")).alias("over"),
    )
    assert len(model.fit_encoding(df, ["x"], ["full"]).levels["full"]) == 1_000
    with pytest.raises(ValueError, match="over"):
        model.fit_encoding(df, ["x"], ["full", "over"])
    assert len(model.fit_encoding(df, ["x"], ["over"], max_levels=1_001).levels["over"]) == 1_001
