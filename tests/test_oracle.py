"""Every query against its SQL on DuckDB. ORACLE_SF chooses other tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from riskflow.plans import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TRAINED = {
    "bootstrap_se", "train_lr", "train_gbt", "candidate_compare", "oof_threshold",
    "param_search", "score_batch", "ablation_compare", "leak_report",
}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert oracle.check(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


def test_only_trained_and_resampled_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == TRAINED


def test_entry_offers_all_of_them():
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLES.items() <= entry.oracle_sql().items()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
