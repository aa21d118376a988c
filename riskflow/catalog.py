"""Names, limits and tables that the operators take as their defaults.

Values marked as fixed must be these for results to be the same. Column names are those
of the records in small letters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

# Column roles of an application record.
NUMERIC = [
    "limit_bal", "age",
    "bill_amt1", "bill_amt2", "bill_amt3", "bill_amt4", "bill_amt5", "bill_amt6",
    "pay_amt1", "pay_amt2", "pay_amt3", "pay_amt4", "pay_amt5", "pay_amt6",
]
CATEGORICAL = [
    "sex", "education", "marriage", "pay_0", "pay_2", "pay_3", "pay_4", "pay_5", "pay_6",
]
PROTECTED = ["sex", "marriage", "age"]
AUDITED = ["sex", "marriage", "age", "education"]
STATIC = ["limit_bal", "sex", "education", "marriage", "age"]
TARGET = "default_payment_next_month"

# Statement month, then the status, bill and payment column it is stored in.
PERIODS = [
    (dt.date(2005, 4, 1), "pay_6", "bill_amt6", "pay_amt6"),
    (dt.date(2005, 5, 1), "pay_5", "bill_amt5", "pay_amt5"),
    (dt.date(2005, 6, 1), "pay_4", "bill_amt4", "pay_amt4"),
    (dt.date(2005, 7, 1), "pay_3", "bill_amt3", "pay_amt3"),
    (dt.date(2005, 8, 1), "pay_2", "bill_amt2", "pay_amt2"),
    (dt.date(2005, 9, 1), "pay_0", "bill_amt1", "pay_amt1"),
]
MONTHS = [p[0] for p in PERIODS]
OUTCOME_MONTH = dt.date(2005, 10, 1)

# Codes without a documented meaning and the code they count as.
FOLDED_CODES = {"education": ([0, 5, 6], 4), "marriage": ([0], 3)}

# Bands of the age column, each [low, high).
AGE_EDGES = [18, 30, 45, 60, 120]

# Delayed labels.
WINDOW_DAYS = 30
HOLDOUT_RATE = 0.02
MATURITY_OFFSETS = [90, 150, 180, 210, 240, 270, 330, 400]
HOLDOUT_RATES = [0.01, 0.02, 0.05, 0.10, 0.25]
HOLDOUT_DRAWS = 25
UNUSABLE_STD_ERROR = 0.15
MIN_EFFECTIVE_ROWS = 100.0
MIN_COVERAGE = 0.5

# Decisions.
COST_FALSE_NEGATIVE = 5.0
COST_FALSE_POSITIVE = 1.0
CUTOFFS = [i / 100 for i in range(5, 95)]
DEFAULT_CUTOFF = 0.5
MIN_PR_AUC = 0.50
MAX_REGRESSION = 0.01
MAX_SELECTION_GAP = 0.1
TOP_REASONS = 4

# Drift.
MAX_DRIFTED_SHARE = 0.3
DRIFT_LIMIT = 0.1
P_VALUE_LIMIT = 0.05

# Splits.
SEED = 42
CURRENT_SHARE = 0.25
TEST_SHARE = 0.2

# Upper bounds of the score histogram.
SCORE_BOUNDS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

# Wording of the reasons that an applicant reads.
DESCRIPTIONS = {
    "limit_bal": "credit limit",
    "pay_0": "repayment status in the most recent month",
    "pay_2": "repayment status two months ago",
    "pay_3": "repayment status three months ago",
    "pay_4": "repayment status four months ago",
    "pay_5": "repayment status five months ago",
    "pay_6": "repayment status six months ago",
    "education": "education category",
    "bill_amt1": "most recent statement balance",
    "bill_amt2": "statement balance two months ago",
    "bill_amt3": "statement balance three months ago",
    "bill_amt4": "statement balance four months ago",
    "bill_amt5": "statement balance five months ago",
    "bill_amt6": "statement balance six months ago",
    "pay_amt1": "amount paid in the most recent month",
    "pay_amt2": "amount paid two months ago",
    "pay_amt3": "amount paid three months ago",
    "pay_amt4": "amount paid four months ago",
    "pay_amt5": "amount paid five months ago",
    "pay_amt6": "amount paid six months ago",
}


#: What each column of an application record holds.
KINDS = dict.fromkeys(NUMERIC, "number") | dict.fromkeys(CATEGORICAL, "code")


def model_inputs(hidden: Iterable[str] = PROTECTED) -> tuple[list[str], list[str]]:
    """Numbers and codes of a record, in the order of ``KINDS``, without the ``hidden`` columns."""
    sorted_in: dict[str, list[str]] = {"number": [], "code": []}
    for column, kind in KINDS.items():
        if column not in hidden:
            sorted_in[kind].append(column)
    return sorted_in["number"], sorted_in["code"]
