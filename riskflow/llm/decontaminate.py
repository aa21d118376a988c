"""Benchmark decontamination: an exact containment join on the rarest shingle of each window.

A window of an item is a run of words. As a set of shingles it is contained in a
document only if its prefix is, and for full containment the prefix is one shingle:
the rarest of the window, by counts over all documents. So

1. a Bloom filter of the benchmark's shingles picks their occurrences in the
   documents while the words stream by, each with the few words around it that a
   window could cover; the texts are read once;
2. these occurrences are counted, which gives the rarity order and each window's prefix;
3. occurrences of prefix shingles meet the windows in a join, where the offset of the
   shingle gives the only possible start and the length bound says whether the window
   fits into the document there;
4. the words around are compared with the window's, exactly; a window that many items
   share is joined and compared once, and its items are attached to documents in the end.

Only occurrences of benchmark shingles are shuffled, never texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import as_column
from riskflow.llm.bloom import Bloom, build_bloom
from riskflow.llm.common import fresh, stored

#: What separates words of an item or document, after A-Z are lower-cased: all of ASCII
#: but digits and small letters. Fixed by the data contract.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, which is enough to count words.
_RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
SHINGLE = 3

#: Columns that ``decontaminate`` adds.
ADDED = ("n_words", "n_hit", "items", "contaminated")

#: Bits of the filters for each shingle of the benchmark: few false candidates.
BITS_PER_KEY = 64


def small_letters(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the general function does just that to ASCII, and faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _split(text: Column | str) -> Column:
    """Words, with an empty first or last one where the text starts or ends in a gap."""
    return F.split(small_letters(F.coalesce(as_column(text), F.lit(""))), _GAP)


def exact_words(text: Column | str) -> Column:
    return F.filter(_split(text), lambda w: w != "")


def count_words(text: Column | str) -> Column:
    w = F.split(F.coalesce(as_column(text), F.lit("")), _RAW_GAP)
    ends = (F.get(w, F.lit(0)) == "").cast("int") + (F.get(w, F.size(w) - 1) == "").cast("int")
    return F.greatest(F.size(w) - ends, F.lit(0)).cast("long")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct (item, words, k, w1, w2): each run of ``window`` words, or a shorter item as a whole.

    ``w1`` and ``w2``, two hashes of the words, name a window together.
    """
    df = items.select(F.col("item_id").cast("string").alias("item"), exact_words("text").alias("w"))
    df = df.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    df = df.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    named = df.distinct().withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    return named.select("*", F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(1), "words").alias("w2"))


def occurrences(docs: DataFrame, k: int, known: Bloom, window: int) -> DataFrame:
    """(doc_id, doc_hash, pos, token, before, around) of the shingles of k words that pass the filter.

    ``around`` has the words that a window over the shingle could cover, ``before`` of
    them in front of it. Generate, filter and projection run in one code stage: only
    what passes is copied.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), _split("text").alias("w"))
    # The outer form keeps the optimiser from splitting every text twice.
    at = words.select("doc_id", "doc_hash", "w", F.posexplode_outer("w").alias("pos", "first"))
    token = F.xxhash64("first", *[F.get("w", F.col("pos") + i) for i in range(1, k)])
    # Not the empty words that gaps at the ends leave.
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    size = F.size("w") - (F.get("w", F.size("w") - 1) == "").cast("int")
    fits = (F.col("pos") >= lead) & (F.col("pos") + k <= size)
    at = at.withColumn("token", token).filter(known.might_contain(F.col("token")) & fits)
    before = F.least(F.col("pos") - lead, F.lit(window - 1))
    around = F.slice("w", F.col("pos") - before + 1, before + F.least(F.lit(window), size - F.col("pos")))
    pos = (F.col("pos") - lead).alias("pos")
    return at.select("doc_id", "doc_hash", pos, "token", before.alias("before"), around.alias("around"))


def find_windows(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct occurrences (doc_id, doc_hash, start, length, w1, w2) of stored item windows in documents.

    ``start`` counts words from 0. ``doc_hash`` tells apart rows that share a doc_id.
    """
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())
    found = [_find(docs, windows.filter(F.col("k") == k), k, window) for k in sizes]
    if not found:
        empty = docs.limit(0).select("doc_id", F.xxhash64("text").alias("doc_hash"))
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("w1", "long"), ("w2", "long"))])
    return reduce(DataFrame.unionByName, found)


def _find(docs: DataFrame, windows: DataFrame, k: int, window: int) -> DataFrame:
    tokens = F.transform(
        F.sequence(F.lit(0), F.size("words") - k),
        lambda i: F.struct(i.alias("offset"), F.xxhash64(*[F.get("words", i + j) for j in range(k)]).alias("token")),
    )
    texts = windows.groupBy("w1", "w2").agg(F.any_value("words").alias("words"))
    shingles = stored(texts.select("*", F.explode(tokens).alias("t")).select("w1", "w2", "words", "t.*"))
    own = shingles.select("token").distinct()
    known = build_bloom(own, "token", own.count(), BITS_PER_KEY)
    places = stored(occurrences(docs, k, known, window))
    # The rarity of every shingle of the benchmark, counted over all documents.
    seen = places.groupBy("token").agg(F.count("*").alias("seen"))
    ranked = shingles.join(seen, "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rarest = Window.partitionBy("w1", "w2").orderBy("seen", "token", "offset")
    prefix = ranked.withColumn("_n", F.row_number().over(rarest)).filter("_n = 1 and seen > 0")
    prefix = stored(prefix.select("w1", "w2", "words", "offset", "token"))
    joined = places.join(prefix, "token")
    # Positional and length bounds, then the words themselves.
    start, length = F.col("pos") - F.col("offset"), F.size("words")
    first = F.col("before") - F.col("offset")
    inside = (first >= 0) & (F.size("around") - first >= length)
    hit = joined.filter(inside & (F.slice("around", F.greatest(first, F.lit(0)) + 1, length) == F.col("words")))
    return hit.select("doc_id", "doc_hash", start.alias("start"), length.alias("length"), "w1", "w2").distinct()


def covered(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, n_hit, items): words inside any occurrence, and the items, per document.

    ``hits`` is stored. Items meet a window once per document, however often it occurs there.
    """
    doc = ["doc_id", "doc_hash"]
    runs = hits.groupBy(*doc, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = Window.partitionBy(*doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    runs = runs.withColumn("new", F.greatest(new, F.lit(0)))
    n_hit = runs.groupBy(*doc).agg(F.sum("new").alias("n_hit"))
    found = hits.select(*doc, "w1", "w2").distinct().join(windows.select("w1", "w2", "item"), ["w1", "w2"])
    items = found.groupBy(*doc).agg(F.sort_array(F.collect_set("item")).alias("items"))
    on = n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["doc_hash"] == items["doc_hash"])
    return n_hit.join(items, on).select(n_hit["doc_id"], n_hit["doc_hash"], "n_hit", "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with n_words, n_hit, items (sorted item ids as strings) and contaminated.

    Null texts have no words and are never contaminated; a null item text or an item
    without words has no window; item rows with the same id act as one item, a null
    item id is left out of ``items`` but hits. Rows that share a doc_id are judged by
    their own text, repeated rows alike. Input columns named like the added ones are
    replaced. Empty tables give no rows, or rows without hits.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    own, doc, code = fresh(docs, "_own", "_doc", "_hash")
    windows = stored(item_windows(items, window))
    hits = covered(stored(find_windows(docs.select("doc_id", "text"), windows, window)), windows)
    hits = hits.withColumnsRenamed({"doc_id": doc, "doc_hash": code})
    base = docs.select(*kept, count_words("text").cast("long").alias("n_words"), F.xxhash64("text").alias(own))
    on = base["doc_id"].eqNullSafe(hits[doc]) & (base[own] == hits[code])
    joined = base.join(hits, on, "left")
    return joined.select(
        *kept,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
