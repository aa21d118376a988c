import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import hash_uniform
from riskflow.operators import decide, fairness, metrics
from riskflow.operators.prefix import exact_quantiles, ordered_prefix, range_bounds, with_range
from riskflow.operators.replicates import (
    block_counts,
    block_of,
    by_score,
    replicate_pr_auc,
    resample_weights,
)


def average_precision(y, p, w):
    """Brute force: precision at every distinct score, weighted by the gain in recall."""
    total, found, last = w[y == 1].sum(), 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        hit = p >= cut
        tp = w[hit & (y == 1)].sum()
        found += (tp - last) / total * tp / w[hit].sum()
        last = tp
    return found


def area(y, p, w):
    """Brute force over all pairs, a tie counts half."""
    top, low = y == 1, y == 0
    wins = (p[top][:, None] > p[low][None, :]) + 0.5 * (p[top][:, None] == p[low][None, :])
    return (wins * w[top][:, None] * w[low][None, :]).sum() / (w[top].sum() * w[low].sum())


@pytest.fixture(scope="module")
def scored(spark):
    """Half of the rows share one score."""
    df = spark.range(600).withColumn("u", F.round(hash_uniform("id", 1), 2))
    return df.select(
        "id",
        F.when(F.col("id") % 2 == 0, 0.4).otherwise(F.col("u")).alias("p"),
        (hash_uniform("id", 2) < 0.3).cast("int").alias("y"),
        F.round(1 + 3 * hash_uniform("id", 3), 1).alias("w"),
    ).cache()


def arrays(df):
    found = df.select("y", "p", "w").toPandas()
    return found["y"].to_numpy(), found["p"].to_numpy(), found["w"].to_numpy()


@pytest.mark.parametrize("bounds", [[], [0.4], [0.1, 0.39, 0.4, 0.41, 0.8], None])
@pytest.mark.parametrize("weight", [None, "w"])
def test_ranking_against_brute_force(scored, weight, bounds):
    y, p, w = arrays(scored)
    w = w if weight else np.ones(len(y))
    made = metrics.ranking(scored, "y", "p", weight, bounds=bounds).first()
    assert made.pr_auc == pytest.approx(average_precision(y, p, w))
    assert made.roc_auc == pytest.approx(area(y, p, w))
    assert made.brier == pytest.approx((w * (p - y) ** 2).sum() / w.sum())
    assert made.effective_rows == pytest.approx(w.sum() ** 2 / (w**2).sum())
    clipped = np.clip(p, metrics.EPSILON, 1 - metrics.EPSILON)
    loss = -(w * (y * np.log(clipped) + (1 - y) * np.log(1 - clipped))).sum() / w.sum()
    assert made.log_loss == pytest.approx(loss)


def test_groups_are_ranked_apart(scored):
    split = scored.withColumn("part", F.col("id") % 3)
    made = {r.part: r.pr_auc for r in metrics.ranking(split, "y", "p", by=["part"]).collect()}
    for part in range(3):
        y, p, w = arrays(split.where(F.col("part") == part))
        assert made[part] == pytest.approx(average_precision(y, p, np.ones(len(y))))


def test_one_class_has_no_ranking_but_a_brier_score(scored):
    made = metrics.ranking(scored.where("y = 0"), "y", "p").first()
    assert made.pr_auc is None and made.roc_auc is None and made.brier > 0


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_carries_totals_and_neighbours(scored, descending):
    made = ordered_prefix(scored, "p", {"n": F.lit(1)}, descending=descending, bounds=[0.2, 0.4, 0.7])
    found = sorted(made.collect(), key=lambda r: r.p, reverse=descending)
    running = 0
    for row, after in zip(found, [*found[1:], None], strict=True):
        running += row.n
        assert row.cum_n == running and row.all_n == 600
        assert row.next_p == (after.p if after else None)


def test_ranges_are_even_and_hold_whole_values(spark):
    df = spark.range(10_000).withColumn("x", F.col("id") * F.col("id"))
    counts = with_range(df, "x", range_bounds(df, "x", 8)).groupBy("_range").count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 2000


def test_exact_quantiles_match_numpy(scored):
    _, p, _ = arrays(scored)
    probs = {"a": 0.1, "b": 0.5, "c": 0.95, "top": 1.0}
    made = exact_quantiles(scored, "p", probs).first()
    assert list(made) == pytest.approx(np.quantile(p, list(probs.values())).tolist())


def test_calibrated_scores_lie_on_the_diagonal(calibrated):
    made = metrics.calibration(calibrated, "y", "p").collect()
    assert len(made) == 10 and sum(r.rows for r in made) == 20_000
    assert all(abs(r.mean_predicted - r.observed_frequency) < 0.05 for r in made)


def test_confusion_counts_and_f1(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 1), (0.8, 0), (0.1, 0), (0.5, 1)], "p double, y int")
    made = metrics.confusion(df, "y", "p", 0.5).first()
    assert tuple(made)[:4] == (1, 1, 1, 2) and made.f1 == pytest.approx(4 / 6)
    assert metrics.confusion(df.where("y = 0"), "y", "p", 2.0).first().f1 == 0


def test_curve_ends_at_full_recall(scored):
    made = metrics.pr_curve(scored, "y", "p").orderBy("threshold").collect()
    assert made[0].recall == 1 and all(0 <= r.precision <= 1 for r in made)


def test_unit_weights_repeat_the_plain_metric(scored):
    def ones(rows, number):
        n, place = by_score(rows["p"])
        hit = rows["y"].to_numpy() == 1
        count = rows["n"].to_numpy(dtype=float)
        return lambda r: (
            np.bincount(place, count * hit * (r + 1), n),
            np.bincount(place, count * ~hit * (r + 1), n),
        )

    cells = scored.groupBy("p", "y").agg(F.count("*").alias("n"))
    made = replicate_pr_auc(cells, "p", 3, ones, [0.3, 0.4, 0.6]).collect()
    plain = metrics.ranking(scored, "y", "p").first().pr_auc
    assert sorted(r.replicate for r in made) == [0, 1, 2]
    assert all(r.pr_auc == pytest.approx(plain) for r in made)


def test_bootstrap_error_is_near_brute_force(scored):
    y, p, w = arrays(scored)
    rng = np.random.default_rng(0)
    draws = []
    for _ in range(60):
        i = rng.integers(0, len(y), len(y))
        draws.append(average_precision(y[i], p[i], w[i]))
    cuts = [0.3, 0.5]
    made = metrics.bootstrap_std_error(scored, "y", "p", "w", draws=80, bounds=cuts).first()
    assert made.draws == 80 and made.std_error == pytest.approx(np.std(draws, ddof=1), rel=0.35)
    moved = scored.repartition(5)
    for other in (cuts, [0.1, 0.2, 0.4, 0.45, 0.7], []):
        again = metrics.bootstrap_std_error(moved, "y", "p", "w", draws=80, bounds=other).first()
        assert again.std_error == pytest.approx(made.std_error, rel=1e-9)


def folded(df):
    return df.groupBy("p", "y", "w").agg(F.count("*").alias("n"))


def test_draws_have_exactly_as_many_rows_in_any_layout(scored):
    made = {}
    for parts, cuts in [(3, [0.3, 0.5]), (8, [0.1, 0.2, 0.41, 0.45, 0.7]), (16, []), (32, [0.5, 7.0, -1.0])]:
        found = metrics.bootstrap_totals(scored.repartition(parts), "y", "p", draws=20, bounds=cuts).collect()
        assert [r.positives + r.negatives for r in found] == [scored.count()] * 20
        made[parts] = sorted((r.draw, r.positives) for r in found)
    assert len({tuple(v) for v in made.values()}) == 1
    assert len({p for _, p in made[3]}) > 5


def test_scores_beyond_the_unit_range_are_drawn_too(spark):
    given = [(x, float(i % 2), 1.0) for i, x in enumerate([-3.0, 0.0, 0.5, 1.0, 2.5] * 40)]
    odd = [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.5, None, 1.0)]
    df = spark.createDataFrame(given + odd, "p double, y double, w double")
    for cuts in ([], [0.0, 0.5, 1.0]):
        found = metrics.bootstrap_totals(df, "y", "p", draws=5, bounds=cuts).collect()
        assert [r.positives + r.negatives for r in found] == [200] * 5


def test_a_cell_is_drawn_binomially_whatever_its_size():
    """Mean and variance of a cell's number, for a cell of one row and one of 4,000."""
    cells = pd.DataFrame({"p": [0.1, 0.1, 0.6], "y": [0, 1, 1], "w": 1.0, "n": [995, 4_000, 5]})
    known = (np.unique(block_of(cells["p"].to_numpy())), np.array([4_995, 5]))
    weigh = resample_weights(3, "p", "y", "w", "n", known)(cells, 0)
    drawn = np.array([(*weigh(r)[0], *weigh(r)[1]) for r in range(4_000)])
    assert (drawn.sum(axis=1) == 5_000).all()
    for column, n in [(0, 5), (1, 4_000), (3, 995)]:
        x, q = drawn[:, column], n / 5_000
        assert x.mean() == pytest.approx(n, abs=4 * np.sqrt(n * (1 - q) / 4_000))
        assert x.var() == pytest.approx(n * (1 - q), rel=0.1)


def test_resample_weights_have_the_mean_of_the_counts(scored):
    cells = folded(scored)
    known = block_counts(cells, "p", "n")
    weigh = resample_weights(1, "p", "y", "w", "n", known)(cells.toPandas(), 0)
    total = np.mean([sum(part.sum() for part in weigh(r)) for r in range(200)])
    pairs = cells.agg(F.sum(F.col("n") * F.col("w"))).first()[0]
    assert total == pytest.approx(pairs, rel=0.02)


def test_estimates_can_be_unusable(spark):
    one = spark.createDataFrame([(99.0,)], "effective_rows double")
    error = spark.createDataFrame([(0.01,)], "std_error double")
    assert metrics.usable(one, error).first().usable is False
    assert metrics.usable(one, error, min_rows=50).first().usable is True
    none = spark.createDataFrame([(None,)], "std_error double")
    assert metrics.usable(one, none, min_rows=50).first().usable is False


@pytest.mark.parametrize(("fn", "fp"), [(5, 1), (1, 1), (1, 4)])
def test_cutoff_is_near_the_closed_form(calibrated, fn, fp):
    made = decide.threshold_choice(decide.threshold_curve(calibrated, "y", "p", fn, fp)).first()
    assert abs(made.threshold - fp / (fn + fp)) < 0.06
    assert made.expected_cost <= made.cost_at_half
    one = decide.expected_cost(calibrated, "y", "p", made.threshold, fn, fp).first()
    assert one.expected_cost == pytest.approx(made.expected_cost)


def test_cost_by_hand(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.1), (1, 0.9), (1, 0.1)], "y int, p double")
    assert decide.expected_cost(df, "y", "p", 0.5, 5, 1).first()[0] == 1.5
    curve = decide.threshold_curve(df, "y", "p", grid=[0.05, 0.5, 0.9])
    assert rows(curve.select("threshold", "decline_rate")) == [(0.05, 1.0), (0.5, 0.5), (0.9, 0.5)]


GATE = [
    (0.56, None, []),
    (0.22, None, ["below the floor"]),
    (0.52, 0.60, ["worse than the champion"]),
    (0.595, 0.60, []),
    (0.65, 0.60, []),
    (None, 0.60, ["no challenger"]),
]


@pytest.mark.parametrize(("challenger", "champion", "reasons"), GATE)
def test_gate(spark, challenger, champion, reasons):
    data = [(a, v) for a, v in (("challenger", challenger), ("champion", champion)) if v]
    made = decide.quality_gate(spark.createDataFrame(data, "alias string, pr_auc double")).first()
    assert made.reasons == reasons and made.passed == (not reasons)


@pytest.mark.parametrize(("passed", "force", "champion"), [(True, False, 3), (False, False, 1), (False, True, 3)])
def test_promotion_follows_the_gate_or_force(spark, passed, force, champion):
    versions = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "model string, version int")
    aliases = spark.createDataFrame([("m", "champion", 1)], "model string, alias string, version int")
    gate = spark.createDataFrame([(passed,)], "passed boolean")
    made = {r.alias: r.version for r in decide.promote(aliases, versions, gate, force).collect()}
    assert made == {"challenger": 3, "champion": champion}


def test_best_candidate_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "candidate string, pr_auc double")
    assert decide.best_candidate(df).first().candidate == "a"


def test_planted_bias_shows_and_even_hands_do_not(spark):
    df = spark.range(200).select(
        (F.col("id") % 2 + 1).alias("sex"),
        (F.col("id") % 2).cast("int").alias("unfair"),
        (F.col("id") % 4 >= 2).cast("int").alias("fair"),
        (F.col("id") % 8 >= 4).cast("int").alias("y"),
        F.lit("x").alias("only"),
    )
    biased = fairness.gaps(fairness.audit(df, "y", "unfair", ["sex", "gone"])).first()
    assert biased.selection_rate_gap == 1 and not biased.within_limit
    even = fairness.gaps(fairness.audit(df, "y", "fair", ["sex"])).first()
    assert even.selection_rate_gap == 0 and even.within_limit
    single = fairness.gaps(fairness.audit(df, "y", "unfair", ["only"])).first()
    assert single.groups == 1 and single.selection_rate_gap == 0


def test_audit_of_many_attributes_equals_one_by_one(applications):
    df = applications.withColumn("prediction", (F.col("pay_0") > 1).cast("int"))
    made = fairness.audit(df, catalog.TARGET, "prediction", catalog.AUDITED)
    for attribute in catalog.AUDITED:
        alone = fairness.group_rates(df, attribute, catalog.TARGET, "prediction")
        assert rows(made.where(F.col("attribute") == attribute).drop("attribute")) == rows(alone)


def test_ages_are_banded_and_outsiders_left_out(spark):
    df = spark.createDataFrame([(a, 1, 1) for a in (21, 35, 50, 70, 17, 120)], "age int, y int, d int")
    made = fairness.audit(df, "y", "d", ["age"], {"age": catalog.AGE_EDGES})
    assert {r.group for r in made.collect()} == {"18-30", "30-45", "45-60", "60-120"}


def test_empty_positives_can_be_excluded(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 0, 0), ("c", 1, 1)], "g string, y int, d int")
    audited = fairness.audit(df, "y", "d", ["g"])
    assert fairness.gaps(audited).first().equal_opportunity_gap == 1
    assert fairness.gaps(audited, exclude_empty=True).first().equal_opportunity_gap == 0
