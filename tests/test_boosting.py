"""Second-order boosting against a plain search of all splits, and the search over its parameters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.operators import boosting
from riskflow.operators.boosting import Params

LABEL = catalog.TARGET


def plain_tree(x, g, h, p, depth=0):
    """All splits at all values, one node at a time."""
    weight = lambda rows: -np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - p.lasso, 0) / (h[rows].sum() + p.ridge)
    gain = lambda rows: max(abs(g[rows].sum()) - p.lasso, 0) ** 2 / (h[rows].sum() + p.ridge)
    every = np.arange(len(g))

    def grow(rows, depth):
        best = (1e-9, None, None)
        if depth < p.depth:
            for c in range(x.shape[1]):
                for cut in np.unique(x[rows, c])[:-1]:
                    left, right = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                    if min(h[left].sum(), h[right].sum()) >= p.least_hessian:
                        found = gain(left) + gain(right) - gain(rows)
                        best = max(best, (found, c, cut), key=lambda b: b[0] + 1e-9 * (b is best))
        if best[1] is None:
            return np.where(np.isin(every, rows), p.step * weight(rows), 0)
        left = x[rows, best[1]] <= best[2]
        return grow(rows[left], depth + 1) + grow(rows[~left], depth + 1)

    return grow(every, 0)


@pytest.mark.parametrize("p", [Params(depth=3), Params(depth=2, ridge=5.0, lasso=2.0), Params(depth=5, least_hessian=6.0, ridge=0.01)])
def test_splits_are_the_best_of_all(p):
    draw = np.random.default_rng(4)
    bins = draw.integers(1, 12, (300, 4)).astype(np.uint8)
    label = (draw.random(300) < 0.2 + 0.5 * (bins[:, 0] > 6)).astype(float)
    chance = np.full(300, label.mean())
    g, h = chance - label, chance * (1 - chance)
    tree = boosting._grow(bins, g, h, np.arange(4), p)
    assert np.allclose(boosting._leaves(tree, bins), plain_tree(bins, g, h, p))


def test_scores_follow_the_planted_signal_and_equal_the_tables(spark, applications):
    columns = ["pay_0", "age", "limit_bal"]
    holed = applications.withColumn("age", F.when(F.col("customer_id") % 10 > 0, F.col("age")))
    sample = boosting.draw_sample(holed, "customer_id", LABEL, columns)
    model = boosting.fit(sample, Params(rounds=40))
    again = boosting.fit(boosting.draw_sample(holed.repartition(7), "customer_id", LABEL, columns), Params(rounds=40))
    scored = model.margins(holed).select("customer_id", "margin", LABEL, *columns)
    assert again.margins(holed).select("margin").exceptAll(scored.select("margin")).count() == 0
    means = {r[LABEL]: r["m"] for r in scored.groupBy(LABEL).agg(F.avg("margin").alias("m")).collect()}
    assert means[1] > means[0] + 1
    # The model as rows, walked in SQL: eight levels are more than it has.
    nodes = model.tables(spark).cache()
    walk = scored.crossJoin(spark.range(40).select(F.col("id").cast("int").alias("tree"))).withColumn("node", F.lit(0))
    for _ in range(5):
        walk = walk.join(nodes, ["tree", "node"])
        value = F.coalesce(F.when(F.col("column") == "age", F.col("age")).when(F.col("column") == "pay_0", F.col("pay_0")).when(F.col("column") == "limit_bal", F.col("limit_bal")).cast("double"), F.lit(float("-inf")))
        step = F.when(F.col("column").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + (value > F.col("threshold")).cast("int"))
        walk = walk.withColumn("node", step).drop("column", "threshold", "value")
    total = walk.join(nodes, ["tree", "node"]).groupBy("customer_id").agg(F.sum("value").alias("v"))
    off = total.join(scored, "customer_id").filter(F.abs(F.col("v") + model.base - F.col("margin")) > 1e-9)
    assert total.count() == 400 and off.count() == 0


def test_sample_is_bounded_and_out_of_fold_covers_it(spark, applications):
    folded = applications.withColumn("fold", F.col("customer_id") % 3)
    sample = boosting.draw_sample(folded, "customer_id", LABEL, ["pay_0", "age"], most=150, fold="fold")
    assert len(sample.label) == 150
    trials = {"a": Params(rounds=5), "b": Params(rounds=9, step=0.2)}
    made = boosting.cross_fit(spark, sample, trials, 3).toPandas()
    assert len(made) == 300 and not made.duplicated(["trial", "row"]).any()
    held = made[(made["trial"] == "b") & (made["fold"] == 1)]
    seen = sample.fold != 1
    base, trees = boosting.boost(sample.bins[seen], sample.label[seen], trials["b"])
    want = base + sum(boosting._leaves(t, sample.bins[~seen]) for t in trees)
    assert np.allclose(held.sort_values("row")["margin"], want)


def test_proposals_stay_in_the_space_and_move_to_what_was_good():
    seen = []
    for batch in range(8):
        for p in boosting.propose(seen, 8, batch):
            for name, (low, high, _) in boosting.SPACE.items():
                assert low <= getattr(p, name) <= high
            assert p.rounds % 100 == 0
            seen.append((p, -abs(np.log(p.step / 0.05)) - abs(p.depth - 6)))
    first, last = (np.mean([s for _, s in part]) for part in (seen[:16], seen[-16:]))
    assert last > first / 2 and seen[:8] == [(p, s) for p, s in zip(boosting.propose([], 8, 0), [s for _, s in seen[:8]], strict=True)]


def test_no_rows_give_a_model_of_nothing(spark, applications):
    sample = boosting.draw_sample(applications.limit(0), "customer_id", LABEL, ["age"])
    model = boosting.fit(sample, Params(rounds=3))
    assert model.score(applications).filter("probability <> 0.5").count() == 0
