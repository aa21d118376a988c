"""Language of web pages by Bayesian evidence fusion.

Evidence: the page's visible text (hashed letter triples, naive Bayes, learned from
documents of known language), the language its markup declares, and where it
lives. The text alone gives a first guess; grouped counts of these guesses over all
pages say how far a declaration can be trusted, and give each host a prior that is
smoothed towards its domain's, that towards its suffix's, and that towards all
pages'. A page's own guess is taken out of its priors again. The posterior is the
product of the three.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import attach, stored
from riskflow.llm.urls import host_of

PLACES = 1 << 16
_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)"


class _Places(dict):
    """Places of a word's letter triples."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        w = f" {word} "
        found = self[word] = [zlib.crc32(w[i : i + 3].encode()) & (PLACES - 1) for i in range(len(w) - 2)]
        return found


def visible_text(page: str) -> str:
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def triples(text: str, places: _Places) -> np.ndarray:
    return np.array([p for w in _LETTERS.findall(text.lower()) for p in places[w]], np.int64)


def fit_text(docs: DataFrame, rows: int = 8_192, seed: int = 8) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log shares of the letter triples (languages x places).

    The languages are those of all documents with a letter. Each is learned from at most
    ``rows`` distinct texts of its own, those with the smallest hashes, so a rare one is
    learned from all it has and none falls out. Each task adds up its own counts; as many
    rows as languages times places, at most, come to the driver.
    """
    known = docs.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}")).select("lang", "text")
    code = F.xxhash64(F.lit(seed), "text")
    hashes = stored(known.select("lang", code.alias("h")).distinct())
    sizes = hashes.groupBy("lang").count().withColumnRenamed("lang", "_lang")
    # Hashes are even: a language's smallest lie below a share of their range, so that
    # no task orders a whole language. Twice the share leaves enough for any draw.
    share = F.least(2.0 * rows / F.col("count"), F.lit(1.0))
    low = hashes.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).filter(
        (share == 1.0) | (F.col("h") / F.lit(2.0**64) + 0.5 <= share)
    )
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    tops = stored(low.withColumn("_n", n).filter(F.col("_n") <= rows).groupBy(F.col("lang").alias("_lang")).agg(F.max("h").alias("_top")))
    langs = sorted(r["_lang"] for r in tops.select("_lang").collect())
    if not langs:
        return [], np.zeros((0, PLACES))
    sample = known.join(F.broadcast(tops), (F.col("lang") == F.col("_lang")) & (code <= F.col("_top"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, sums = _Places(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums.setdefault(lang, np.zeros(PLACES, np.int64))
                sums[lang] += np.bincount(triples(text, places), minlength=PLACES)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "place": at, "n": n[at]})

    counted = sample.mapInPandas(count, "lang string, place int, n long")
    found = counted.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(langs), PLACES), 0.5)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[i, own["place"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _likelihoods(pages: DataFrame, table: np.ndarray, most: float) -> Column:
    shared = pages.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, places = shared.value, _Places()
        for batch in batches:
            made = []
            for page in batch:
                at = triples(visible_text(page), places)
                sums = table[:, at].sum(1, dtype=np.float64)
                # Triples of a text depend on each other: a long one counts as ``most``.
                sums = sums * min(1.0, most / max(len(at), 1))
                made.append(np.round(sums - sums.max(initial=-np.inf), 6).tolist())
            yield pd.Series(made)

    return score(F.coalesce(F.col("html"), F.lit("")))


def identify(pages: DataFrame, docs: DataFrame, mass: float = 4.0, most: float = 60.0) -> DataFrame:
    """The pages' page_id with host, suffix, declared, text_lang, lang and posterior.

    ``lang`` is the most probable language, ties to the first in the alphabet, and
    ``posterior`` its probability. A null or empty page has no text evidence and is
    judged by its address and priors; a null url has an empty host; a missing or
    unknown declaration says nothing. Pages are read whole; repeated rows are judged
    alike; no pages give no rows. Without documents of a known language lang is null.
    """
    langs, table = fit_text(docs)
    host = host_of("url")
    pieces = F.split(host, r"\.")
    base = pages.select(
        "page_id",
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.element_at(pieces, -1).alias("suffix"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1)), F.lit("")).alias("declared"),
        (_likelihoods(pages, table, most) if langs else F.array().cast("array<double>")).alias("_text"),
    )
    if not langs:
        none = F.lit(None).cast("string")
        return base.select("page_id", "host", "suffix", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("_text", F.array_max("_text")).cast("int") - 1
    # Without letters the text says nothing and is no guess.
    base = base.withColumn("_guess", F.when(F.array_min("_text") < 0, best))
    base = base.withColumn("declared", F.when(F.col("declared").isin(*langs), F.col("declared")))
    base = stored(base.withColumn("text_lang", F.get(names, F.col("_guess"))))

    def counts(*keys: str) -> DataFrame:
        each = [F.count(F.when(F.col("_guess") == i, 1)) for i in range(len(langs))]
        return base.groupBy(*keys).agg(F.array(*each).alias("_n"))

    everywhere = base.agg(*[F.count(F.when(F.col("_guess") == i, 1)).alias(f"n{i}") for i in range(len(langs))]).first()
    rows = base
    for key in ("suffix", "domain", "host"):
        few = stored(counts(key).withColumnRenamed("_n", f"_{key}_n"))
        rows = attach(rows, few, key)
    # At most one row per language and one for none: how declarations and guesses agree.
    agree = {r["declared"]: r["_n"] for r in counts("declared").collect()}

    def log_prior(i: int) -> Column:
        own = F.coalesce((F.col("_guess") == i).cast("int"), F.lit(0))
        some = F.col("_guess").isNotNull().cast("int")
        total = sum(everywhere)
        share = (F.lit(everywhere[i]) - own + 1.0) / (F.lit(total) - some + float(len(langs)))
        for key in ("suffix", "domain", "host"):
            n = F.get(f"_{key}_n", F.lit(i)) - own
            all_ = F.aggregate(f"_{key}_n", F.lit(0).cast("long"), lambda s, x: s + x) - some
            share = (n + mass * share) / (all_ + mass)
        return F.log(share)

    def log_declared(i: int) -> Column:
        seen = sum(n[i] for d, n in agree.items() if d is not None)
        found = F.lit(0.0)
        for d in langs:
            share = (agree.get(d, [0] * len(langs))[i] + (3.0 if d == langs[i] else 1.0)) / (seen + 2.0 + len(langs))
            found = F.when(F.col("declared") == d, F.lit(float(np.log(share)))).otherwise(found)
        return found

    logs = F.array(*[F.get("_text", F.lit(i)) + log_prior(i) + log_declared(i) for i in range(len(langs))])
    rows = rows.withColumn("_log", logs)
    rows = rows.withColumn("_top", F.array_max("_log"))
    weight = F.aggregate("_log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))
    lang = F.get(names, F.array_position("_log", F.col("_top")).cast("int") - 1)
    return rows.select("page_id", "host", "suffix", "declared", "text_lang", lang.alias("lang"), (1.0 / weight).alias("posterior"))
