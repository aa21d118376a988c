import numpy as np
import pytest
from test_model import shapley

from riskflow.operators import trees


def leaf(draw, features, n):
    """A leaf whose path bounds each feature on one side or on both."""
    low, high = np.sort(draw.normal(size=(2, features)), axis=0)
    side = draw.integers(0, 3, features)
    return trees.Leaf(
        float(draw.normal()),
        tuple(int(f) for f in draw.permutation(n)[:features]),
        tuple(np.where(side == 0, -np.inf, low)),
        tuple(np.where(side == 1, np.inf, high)),
        tuple(draw.random(features)),
    )


def test_gains_are_looked_up_and_equal_the_definition():
    """One table per leaf, whatever the number of rows; sources with two columns, a leaf without a path."""
    draw = np.random.default_rng(3)
    leaves = [leaf(draw, m, 6) for m in (0, 1, 2, 3, 4, 4, 4)]
    tables = trees.gain_tables(leaves)
    assert [t.shape for t in tables] == [(len(x.share), 2 ** len(x.share)) for x in leaves]
    x, source = draw.normal(size=(40, 6)), np.array([0, 1, 1, 2, 3, 3])
    made = trees.attribute(x, leaves, source, 4, tables)
    for row, got in zip(x, made, strict=True):
        alone = np.array([shapley(leaves, row, f, range(6)) for f in range(6)])
        assert got[:4] == pytest.approx(np.bincount(source, alone))
        assert got[4] == pytest.approx(sum(v.value * np.prod(v.share) for v in leaves))
    assert trees.attribute(x[:0], leaves, source, 4).shape == (0, 5)


def test_long_paths_have_no_table_and_the_same_gains(monkeypatch):
    draw = np.random.default_rng(5)
    leaves = [leaf(draw, m, 12) for m in (3, trees.MOST_TABLED, 12)]
    x, source = draw.normal(size=(30, 12)), np.arange(12)
    assert [t is None for t in trees.gain_tables(leaves)] == [False, False, True]
    made = trees.attribute(x, leaves, source, 12)
    monkeypatch.setattr(trees, "MOST_TABLED", 0)
    assert np.abs(made - trees.attribute(x, leaves, source, 12)).max() < 1e-12
