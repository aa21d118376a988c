"""The data contract: cleaning, rules, and what happens to rows that break them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import catalog
from riskflow.functions.scalar import count_where


class ContractBreach(ValueError):
    """Raised with the number of bad rows for every broken rule."""

    def __init__(self, breaches: Mapping[str, int]):
        super().__init__(f"rows that break the contract: {dict(breaches)}")
        self.breaches = dict(breaches)


@dataclass(frozen=True)
class Rule:
    """Bounds or members of one column. A null always breaks the rule."""

    column: str
    kind: str | None = "bigint"
    gt: Any = None
    ge: Any = None
    le: Any = None
    members: Sequence[Any] | None = None
    max_length: int | None = None
    optional: bool = False

    def holds(self) -> Column:
        value = F.col(self.column)
        if self.kind:
            # A value that cannot be coerced turns null and so breaks the rule.
            value = value.try_cast(self.kind)
        checks = [value.isNotNull()]
        if self.gt is not None:
            checks.append(value > F.lit(self.gt))
        if self.ge is not None:
            checks.append(value >= F.lit(self.ge))
        if self.le is not None:
            checks.append(value <= F.lit(self.le))
        if self.members is not None:
            checks.append(value.isin(list(self.members)))
        if self.max_length is not None:
            checks.append(F.length(value) <= F.lit(self.max_length))
        verdict = checks[0]
        for check in checks[1:]:
            verdict = verdict & check
        if self.optional:
            verdict = F.col(self.column).isNull() | verdict
        return F.coalesce(verdict, F.lit(False))


@dataclass(frozen=True)
class Contract:
    rules: tuple[Rule, ...]

    def with_rules(self, *rules: Rule) -> Contract:
        return replace(self, rules=self.rules + rules)

    def require(self, df: DataFrame) -> None:
        missing = [r.column for r in self.rules if r.column not in df.columns]
        if missing:
            raise ValueError(f"columns missing from the frame: {missing}")

    def coerce(self, df: DataFrame) -> DataFrame:
        """Cast to the declared types; other columns pass through. Bad values fail the job."""
        self.require(df)
        return df.withColumns({r.column: F.col(r.column).cast(r.kind) for r in self.rules if r.kind})

    def counts(self, df: DataFrame) -> DataFrame:
        """One row with the number of breaches per rule, from one pass over the data."""
        self.require(df)
        return df.agg(*[count_where(~r.holds()).alias(r.column) for r in self.rules])

    def violations(self, df: DataFrame) -> DataFrame:
        """``rule, n_bad`` for every rule, broken or not."""
        named = [
            F.struct(F.lit(r.column).alias("rule"), F.col(r.column).alias("n_bad"))
            for r in self.rules
        ]
        return self.counts(df).select(F.inline(F.array(*named)))

    def reasons(self) -> Column:
        """Names of the rules that a row breaks, in the order of the contract."""
        return F.array_compact(
            F.array(*[F.when(~r.holds(), F.lit(r.column)) for r in self.rules])
        )

    def judged(self, df: DataFrame) -> DataFrame:
        """Every row with its ``reasons``: one pass serves both sides of the split."""
        self.require(df)
        return df.withColumn("reasons", self.reasons())

    def quarantine(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that keep the contract, and rejected rows with their reasons."""
        judged = self.judged(df)
        good = judged.where(F.size("reasons") == 0).drop("reasons")
        return good, judged.where(F.size("reasons") > 0)

    def enforce(self, df: DataFrame) -> DataFrame:
        """Collect all breaches, then fail once with the full list."""
        row = self.counts(df).first()
        broken = {name: n for name, n in row.asDict().items() if n}
        if broken:
            raise ContractBreach(broken)
        return self.coerce(df)


def fold_codes(df: DataFrame, codes: Mapping[str, tuple[Sequence[int], int]]) -> DataFrame:
    """Count undocumented codes as the documented "other" code; no row is dropped."""
    return df.withColumns(
        {
            column: F.when(F.col(column).isin(list(unknown)), F.lit(other)).otherwise(F.col(column))
            for column, (unknown, other) in codes.items()
        }
    )


def normalise(
    df: DataFrame, target: str, source_target: str, drop: Sequence[str] = ()
) -> DataFrame:
    """Strip header names, give the target its name and type, drop surrogate keys."""
    named = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    named = named.withColumnRenamed(source_target, target)
    if target not in named.columns:
        raise ValueError(f"target column {target!r} is missing; found {named.columns}")
    return named.drop(*drop).withColumn(target, F.col(target).cast("tinyint"))


def project_features(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Only what the model may see: other columns end here, known or not."""
    return df.select(*keep, *numeric, *categorical)


def filled_key(df: DataFrame, key: str, fallback: Column | None = None) -> DataFrame:
    """Give every row a key; a random one unless the caller derives it from the row."""
    return df.withColumn(key, F.coalesce(F.col(key), F.uuid() if fallback is None else fallback))


def decide(df: DataFrame, score: str, cutoff: float | Column, name: str = "prediction") -> DataFrame:
    """1 where the score reaches the cutoff, the cutoff included."""
    return df.withColumn(name, (F.col(score) >= cutoff).cast("int"))


def _application(education: Sequence[int], marriage: Sequence[int], money: dict, paid: dict):
    status = [p[1] for p in reversed(catalog.PERIODS)]
    return Contract(
        (
            # Limits of the application record.
            Rule("limit_bal", gt=0, le=2_000_000),
            Rule("sex", members=[1, 2]),
            Rule("education", members=list(education)),
            Rule("marriage", members=list(marriage)),
            Rule("age", ge=18, le=100),
            *[Rule(c, ge=-2, le=9) for c in status],
            *[Rule(f"bill_amt{i}", **money) for i in range(1, 7)],
            *[Rule(f"pay_amt{i}", **paid) for i in range(1, 7)],
        )
    )


# Cleaned records, as a model is trained on them.
CLEANED = _application(range(1, 5), range(1, 4), {}, {"ge": 0})
# Raw records, as callers send them.
RAW = _application(
    range(0, 7),
    range(0, 4),
    {"ge": -1_000_000, "le": 10_000_000},
    {"ge": 0, "le": 10_000_000},
)
LABELLED = CLEANED.with_rules(Rule(catalog.TARGET, members=[0, 1]))


def clean(df: DataFrame) -> DataFrame:
    """The cleaning that training and scoring share."""
    return fold_codes(df, catalog.FOLDED_CODES)
