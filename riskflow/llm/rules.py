"""Quality rules whose cutoffs are certified not to reject too many good documents.

Rules look at shares counted in a text (symbols, repeated lines, repeated word windows,
word length); a larger value is worse. Labelled documents are split in halves by a hash
of their id. Per stratum

1. the proposal half offers a ladder of cutoffs: on rung j each rule may lose the j-th
   share of the good proposals, so every rung rejects what the rung before it rejects;
   a rule that does not reject a larger share of the bad ones takes no part;
2. on the holdout half the documents that any rule rejects on a rung are counted, good
   ones only. A rung is certified when the exact binomial tail P(X <= count) at the risk
   limit is at most ``delta`` divided by the number of strata (Bonferroni); rungs are
   tested from the mildest on and the first failure ends the climb (a fixed sequence,
   which needs no further correction);
3. of the certified rungs the one that rejects the most bad proposals decides for the
   stratum, the mildest of several. A stratum with too few labels has none and its rules
   reject nothing.

With probability 1 - ``delta`` no stratum loses more than ``risk`` of its good documents
to the rules, as far as its labelled documents are independent draws.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.llm.common import attach, stored, word_count

#: The six ASCII blanks, the symbols and the window that the data contract names.
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 3

#: Limits of the base rule: fixed by the data contract.
FEWEST_WORDS = 50
MOST_REPEATED = 50


@dataclass(frozen=True)
class Risk:
    """Risk limit, error chance and the rungs (good proposals lost per rule, in 1/1000)."""

    risk: float = 0.02
    delta: float = 0.05
    rungs: tuple[int, ...] = (0, 1, 2, 3, 5, 8, 12, 20)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more.

    Windows are compared by hash first; only if two hashes are equal are the windows
    themselves sorted and compared with their neighbours.
    """

    def spots(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - _WINDOW)
        window = [lambda i, o=o: F.get(w, i + o) for o in range(_WINDOW)]
        codes = F.transform(starts, lambda i: F.xxhash64(*[x(i) for x in window]))
        whole = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[x(i) for x in window]).alias("s"), i.alias("i")))

        def covered(a: Column) -> Column:
            twin = F.filter(a, lambda x, j: (x["s"] == F.get(a, j - 1)["s"]) | (x["s"] == F.get(a, j + 1)["s"]))
            places = F.array_sort(F.transform(twin, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

            def add(acc: Column, at: Column) -> Column:
                end = at + _WINDOW
                return F.struct((acc["n"] + end - F.greatest(at, acc["end"])).alias("n"), end.alias("end"))

            return F.aggregate(places, start, add)["n"]

        exact = F.get(F.transform(F.array(F.sort_array(whole)), covered), F.lit(0))
        same = F.get(F.transform(F.array(codes), lambda c: F.size(F.array_distinct(c)) < F.size(c)), F.lit(0))
        return F.when(F.size(w) <= _WINDOW, F.lit(0)).when(same, exact).otherwise(F.lit(0))

    return F.get(F.transform(F.array(words), spots), F.lit(0)).cast("long")


def measures(text: Column | str) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word)."""
    whole = F.coalesce(as_column(text), F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = F.get(F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))), F.lit(0))
    return [
        word_count(whole).alias("n_words"),
        F.length(F.translate(whole, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_words(words).alias("n_repeat_words"),
        lines.alias("_lines"),
    ]


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    """(doc_id, stratum, counts, base_failed) per row, stored: texts are read once and not shuffled."""
    df = stored(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), *measures("text")))
    n = F.col("_lines")
    df = df.withColumns({"n_dup_lines": (n["n"] - n["d"]).cast("long"), "n_lines": n["n"].cast("long")}).drop("_lines")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _share(part: str, of: str, scale: int = 10_000) -> Column:
    """Part of a whole in ``scale``-ths, rounded down, at most 10,000; 0 of nothing."""
    return F.least(F.expr(f"coalesce({part} * {scale}L div nullif({of}, 0), 0L)"), F.lit(10_000)).cast("int")


def rule_values() -> dict[str, Column]:
    """What each rule looks at: whole numbers from 0 to 10,000, larger is worse."""
    length = _share("word_chars", "n_words", 100)
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "long_words": length,
        "short_words": 10_000 - length,
    }


def critical_count(n: Column, risk: float, log_delta: Column) -> Column:
    """Largest k with P(X <= k) <= delta for X binomial (n, risk), -1 if there is none.

    One walk over the terms up to the mean, in logarithms, so no n underflows.
    """
    odds = math.log(risk / (1 - risk))
    start = F.struct(
        (n * F.lit(math.log1p(-risk))).alias("term"), F.lit(float("-inf")).alias("sum"), F.lit(-1).cast("long").alias("k")
    )

    def step(acc: Column, i: Column) -> Column:
        grown = acc["term"] + F.log((n - i + 1).cast("double") / i) + odds
        term = F.when(i == 0, acc["term"]).otherwise(grown)

        def join(t: Column) -> Column:
            high, low = F.greatest(t, acc["sum"]), F.least(t, acc["sum"])
            total = high + F.log1p(F.exp(low - high))
            return F.get(
                F.transform(
                    F.array(total),
                    lambda s: F.struct(t.alias("term"), s.alias("sum"), (acc["k"] + (s <= log_delta).cast("long")).alias("k")),
                ),
                F.lit(0),
            )

        return F.get(F.transform(F.array(term), join), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * F.lit(risk))), start, step)["k"]


def _rung(cutoffs: Column) -> Column:
    """First rung on which some rule rejects the row; a number beyond the last if none does."""

    def passed(name: str, value: Column) -> Column:
        return F.coalesce(F.size(F.filter(cutoffs[name], lambda c: value <= c)), F.lit(2**31 - 1))

    return F.least(*[passed(name, value) for name, value in rule_values().items()])


def fit_cutoffs(rows: DataFrame, labels: DataFrame, risk: Risk | None = None, column: str = "quality") -> DataFrame:
    """(stratum, cutoffs, rung, cutoff, n_good, n_lost, most): what was certified, one row per stratum.

    ``rows`` is from ``measured``. ``cutoffs`` maps a rule to its cutoff on each rung,
    ``cutoff`` to that of the certified rung; ``rung`` is null where none is. Only
    labelled rows that pass the base rule count; an id with several labels has the
    largest. Histograms have at most 10,001 values per rule and stratum.
    """
    risk = risk or Risk()
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    known = rows.filter(~F.col("base_failed")).join(one, "doc_id")
    holdout = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 2 == 1
    known = stored(known.withColumn("holdout", holdout))
    names = list(rule_values())
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("value")) for n, v in rule_values().items()]))
    good, bad = [F.count(F.when(F.col("label") == x, 1)) for x in (1, 0)]
    hist = known.filter("not holdout").select("stratum", "label", each.alias("x")).groupBy("stratum", "x.rule", "x.value")
    hist = hist.agg(good.alias("good"), bad.alias("bad"))
    over = Window.partitionBy("stratum", "rule").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("stratum", "rule")
    above = {f"{c}_above": F.coalesce(F.sum(c).over(over), F.lit(0)) for c in ("good", "bad")}
    hist = hist.withColumns(above | {f"{c}_all": F.sum(c).over(everything) for c in ("good", "bad")}).filter("good > 0")
    at = [F.min(F.when(F.col("good_above") * 1000 <= F.col("good_all") * j, F.col("value"))) for j in risk.rungs]
    last = F.col("good_above") * 1000 <= F.col("good_all") * risk.rungs[-1]
    ends = [F.max_by(c, F.when(last, -F.col("value"))) for c in ("good_above", "bad_above")]
    ladder = hist.groupBy("stratum", "rule").agg(
        F.array(*at).alias("cutoffs"), ends[0].alias("lost"), ends[1].alias("caught"), F.max("good_all").alias("ng"), F.max("bad_all").alias("nb")
    )
    ladder = ladder.filter("caught * ng > lost * nb")
    by_rule = [F.max(F.when(F.col("rule") == n, F.col("cutoffs"))).alias(n) for n in names]
    ladder = stored(ladder.groupBy("stratum").agg(*by_rule).select("stratum", F.struct(*names).alias("cutoffs")))

    # Good holdouts are at risk; bad proposals tell which certified rung is of most use.
    tested = attach(known.filter("holdout = (label = 1)"), ladder, "stratum").withColumn("rung", _rung(F.col("cutoffs")))
    steps = range(len(risk.rungs))
    counts = [F.count(F.when((F.col("label") == y) & (F.col("rung") <= j), 1)).alias(f"{c}{j}") for j in steps for c, y in (("lost", 1), ("caught", 0))]
    strata = stored(tested.groupBy("stratum").agg(good.alias("n_good"), *counts).filter("n_good > 0"))
    share = F.log(F.lit(risk.delta) / F.lit(max(strata.count(), 1)))
    strata = strata.withColumn("most", critical_count(F.col("n_good"), risk.risk, share))
    # The losses grow with the rung, so the rungs within the bound are those before the first failure.
    certified = [F.when(F.col(f"lost{j}") <= F.col("most"), F.struct(F.col(f"caught{j}").alias("caught"), F.lit(-j).alias("j"))) for j in steps]
    strata = strata.withColumn("rung", -F.array_max(F.array(*certified))["j"])
    lost = F.get(F.array(*[f"lost{j}" for j in steps]), F.col("rung")).alias("n_lost")
    model = ladder.withColumnRenamed("stratum", "s")
    model = strata.join(model, F.col("stratum").eqNullSafe(F.col("s")), "left")
    cutoff = F.struct(*[F.get(F.col("cutoffs")[n], F.col("rung")).alias(n) for n in names]).alias("cutoff")
    return stored(model.select("stratum", "cutoffs", "rung", cutoff, "n_good", lost, "most"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk | None = None) -> DataFrame:
    """(doc_id, stratum, counts, base_failed, kept): one row per document row, none dropped.

    A row is kept if it passes the base rule and no rule rejects it on the rung that its
    stratum certified. Null and empty texts have no words and fail the base rule. A null
    stratum is a stratum of its own; one without labelled documents keeps what passes
    the base rule. Repeated rows give repeated rows, a null doc_id is kept as it is,
    other columns are ignored, no rows give none. Texts of any length are counted whole.
    """
    rows = measured(docs, stratum)
    model = fit_cutoffs(rows, labels, risk)
    rows = attach(rows, model.select("stratum", "cutoffs", "rung"), "stratum")
    kept = ~F.col("base_failed") & (F.col("rung").isNull() | F.col("cutoffs").isNull() | (_rung(F.col("cutoffs")) > F.col("rung")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return rows.select("doc_id", "stratum", *counts, "base_failed", kept.alias("kept"))
