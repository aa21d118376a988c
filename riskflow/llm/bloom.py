"""Bloom filters and their cascades as plain columns: bit words in an array literal."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.llm.common import stored


@dataclass(frozen=True)
class Bloom:
    """A power of two of bits, of which two ranges of a 64-bit hash each name one."""

    words: tuple[int, ...]

    def might_contain(self, code: Column) -> Column:
        """``code`` must be a hash already: its low and its high half are the two places."""
        # A JSON text folds into one array literal while the plan is optimised.
        bits = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        hit = F.lit(True)
        for place in _places(code, len(self.words)):
            word = F.get(bits, F.shiftright(place, 6).cast("int"))
            hit = hit & (word.bitwiseAND(_mask(place)) != 0)
        return hit


def _places(code: Column, words: int) -> list[Column]:
    low = F.lit(64 * words - 1).cast("long")
    return [code.bitwiseAND(low), F.shiftrightunsigned(code, 33).bitwiseAND(low)]


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def build_bloom(keys: DataFrame, code: str, count: int, bits_per_key: int) -> Bloom:
    """A filter over ``count`` hashes. Only its words of 64 bits meet the driver, at most 2^25 of them.

    Bits are cheaper here than probes: two probes keep the generated code small enough to
    be compiled. Beyond 2^31 bits the filter lets more pass, but never less.
    """
    words = 1
    while 64 * words < count * bits_per_key and words < 1 << 25:
        words *= 2
    rows = (
        keys.select(F.explode(F.array(*_places(F.col(code), words))).alias("_at"))
        .groupBy(F.shiftright("_at", 6).cast("int").alias("_word"))
        .agg(F.bit_or(_mask(F.col("_at"))).alias("_bits"))
    )
    made = [0] * words
    for r in rows.collect():
        made[r["_word"]] = r["_bits"]
    return Bloom(tuple(made))


@dataclass(frozen=True)
class Cascade:
    """Alternating filters: listed keys, then others that passed, then listed ones that passed, ..."""

    levels: tuple[Bloom, ...]

    def contains(self, key: Column | str) -> Column:
        """Exact for every key of the universe and every listed key. Null keys are not contained."""
        key = as_column(key)
        answer = None
        for i in reversed(range(len(self.levels))):
            hit = self.levels[i].might_contain(_code(key, i))
            if i % 2 == 0:
                answer = hit if answer is None else hit & answer
            else:
                answer = ~hit if answer is None else ~hit | answer
        if answer is None:
            return F.lit(False)
        return key.isNotNull() & answer


def _code(key: Column, level: int) -> Column:
    """Hash of a key for a level: levels must err independently."""
    return F.xxhash64(F.lit(level), key)


def build_cascade(
    listed: DataFrame,
    universe: DataFrame,
    first_bits: int = 64,
    next_bits: int = 16,
    most: int = 64,
) -> Cascade:
    """A cascade for the ``key`` column of ``listed`` that is exact on the ``key`` column of ``universe``.

    The universe is read once and never shuffled: only keys that the first filter
    lets through are made distinct. The work of later levels shrinks with the rate
    of false positives; the last level lets nothing wrong through, which ends the
    building. Both sides ignore null keys. An empty list gives a cascade of no levels.
    """
    inside = stored(listed.select("key").filter("key is not null").distinct())
    count = inside.count()
    levels: list[Bloom] = []
    others: DataFrame | None = None
    while count:
        if len(levels) == most:
            raise ValueError(f"no exact cascade after {most} levels")
        bits = first_bits if not levels else next_bits
        side = inside if len(levels) % 2 == 0 else others
        code = _code(F.col("key"), len(levels))
        levels.append(build_bloom(side.select(code.alias("code")), "code", count, bits))
        test = levels[-1].might_contain(code)
        if others is None:
            passed = universe.select("key").filter("key is not null").filter(test)
            others = stored(passed.join(inside, "key", "left_anti").distinct())
            count = others.count()
        elif len(levels) % 2 == 0:
            inside = stored(inside.filter(test))
            count = inside.count()
        else:
            others = stored(others.filter(test))
            count = others.count()
    return Cascade(tuple(levels))
