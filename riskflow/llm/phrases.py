"""Collocations by stripes: each prefix keys a counter of the words that follow it.

A stripe of a prefix counts, for each next word, how often it follows, and of a single
word, in an entry without a next word, how often it occurs, whatever follows. The total of
a longer prefix is an entry of the stripe one word shorter, so entries give the counts of
all phrases and the largest count among the extensions of each, which tells whether a
longer phrase subsumes the prefix.

Texts are read once per number of words, and each phrase is counted in one reading only.
Words are counted first, as they are spelt, and get a 64-bit hash as their number; if two
words share that of a frequent one, they are counted again by other hashes. Longer phrases
are counted as the numbers of their words, so their counts are exact, and only frequent
ones are spelt, by joins to the frequent words. Tasks fold what they read in sorted arrays
of bounded size and hand on one row per phrase: a prefix with a third of all words spreads
over all tasks when counts are merged.

A phrase can be frequent only if its parts of one word less are, so others are not handed
on. What may be frequent, tasks know from bitmaps of hashes, sized by the number of
frequent phrases. A bitmap that is full can only say yes too often; such a yes costs a
row, which the exact counts then drop, and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.bits import Bits, bitmap
from riskflow.llm.common import BROADCAST_ROWS, stored

#: Limits of the data contract.
FEWEST = 30
LONGEST = 4
SUBSUMED = 80
SCALE = 2_000_000
TOP = 2000

#: One byte that no UTF-8 text holds stands for the end of a piece.
_END = b"\xff"
_BYTES = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
#: Bytes of a text whose words are listed at a time, and codes and infrequent words kept by a task.
_CHUNK, _CODES, _WORDS = 1 << 18, 1 << 18, 1 << 16
#: Numbered words, their bytes, and phrases that a task holds at a time; phrases that it merges with these at a time.
_NAMES, _SPELT, _HASHES, _ENTRIES = 1 << 19, 1 << 25, 1 << 21, 1 << 19
#: Bits by which the hash of a phrase turns before its next word.
_TURN = 21
#: Numbers of the words of a phrase, 0 after its last.
_IDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _hash(word: bytes, seed: int) -> int:
    """64 bits, but never all of them set: that stands for the number of all words of a language."""
    h = xxhash.xxh64_intdigest(word, seed)
    return 0 if h == (1 << 64) - 1 else h


class _Names(dict):
    """Numbers of the words of one language, -1 at the end of a piece; ``names`` are common to all languages."""

    def __init__(self, lang: str, names: list):
        super().__init__({_END: -1})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.names)
        self.names.append((self.lang, word))
        return code


class _Codes(dict):
    """Numbers of the frequent words of one language, -2 for the others, -1 at the end of a piece.

    ``hashes`` of the numbered words are common to all languages; other words are
    forgotten when they are many.
    """

    def __init__(self, lang: str, hashes: list, known: Known):
        super().__init__({_END: -1})
        self.hashes, self.seed = hashes, xxhash.xxh64_intdigest(lang.encode(), known.seed)
        self.table, self.shift = known.bits.table.tobytes(), known.bits.shift
        self.others = 0

    def __missing__(self, word: bytes) -> int:
        h = _hash(word, self.seed)
        # As ``Bits.test`` does for whole columns.
        at = h >> self.shift
        if self.table[at >> 3] >> (at & 7) & 1:
            self[word] = code = len(self.hashes)
            self.hashes.append(h)
            return code
        if self.others > _WORDS:
            kept = {w: c for w, c in self.items() if c > -2}
            self.clear()
            self.update(kept)
            self.others = 0
        self.others += 1
        self[word] = -2
        return -2


def codes_of(text: str, codes: dict) -> np.ndarray:
    """Numbers of the words of a whole text, -1 at the end of each piece."""
    raw = text.encode().translate(_BYTES).replace(_END, b" \xff ")
    made, at = [], 0
    while at < len(raw):
        cut = raw.find(b" ", at + _CHUNK)
        cut = len(raw) if cut < 0 else cut
        found = raw[at:cut].split()
        made.append(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
        at = cut
    return np.concatenate([*made, [-1]])


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, in order; see ``_mixed_column``."""
    return reduce(lambda h, x: (h << np.uint64(_TURN) | h >> np.uint64(64 - _TURN)) ^ x, parts)


def _mixed_column(words: list[Column]) -> Column:
    """What ``_mixed`` makes of the signed hashes of words."""
    return reduce(lambda h, x: F.shiftleft(h, _TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - _TURN)).bitwiseXOR(x), words)


@dataclass
class Known:
    """Phrases of ``size`` words that may be frequent, by their hashes; ``seed`` is that of the words' hashes."""

    size: int
    bits: Bits
    seed: int = 0

    def test(self, parts: list[np.ndarray]) -> np.ndarray:
        return self.bits.test(_mixed(parts))


def word_counts(texts: DataFrame, fewest: int, digest: Callable[[bytes, int], int] = _hash) -> tuple[DataFrame, int]:
    """(h, lang, word, n) of the words that occur ``fewest`` times or more, and of all words of a language together
    under a null word; and the seed of ``h``, by which no word of the texts has the number of one of these. Stored.
    """

    def counted(seed: int) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            langs, names, codes, size, total = {}, [], [], 0, np.zeros(0, np.int64)

            def fold() -> np.ndarray:
                c = np.concatenate(codes)
                n = np.bincount(c[c >= 0], minlength=len(names))
                n[: len(total)] += total
                codes.clear()
                return n

            def rows() -> Iterator[pd.DataFrame]:
                seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), seed) for lang in langs}
                for i in range(0, len(names), 1 << 15):
                    some = names[i : i + (1 << 15)]
                    h = np.fromiter((digest(word, seeds[lang]) for lang, word in some), np.uint64, len(some)).view(np.int64)
                    yield pd.DataFrame({"h": h, "lang": [x for x, _ in some], "word": [x.decode() for _, x in some], "n": total[i : i + (1 << 15)]})
                of = pd.Series([lang for lang, _ in names], dtype=object)
                sums = pd.Series(total).groupby(of).sum()
                yield pd.DataFrame({"h": -1, "lang": list(sums.index), "word": pd.Series([None] * len(sums), dtype=object), "n": sums.to_numpy()})
                langs.clear()
                names.clear()

            spelt = 0
            for batch in batches:
                for lang, text in zip(batch["lang"], batch["text"], strict=True):
                    if lang not in langs:
                        langs[lang] = _Names(lang, names)
                    before = len(names)
                    codes.append(codes_of(text, langs[lang]))
                    size += len(codes[-1])
                    spelt += sum(len(x) for _, x in names[before:])
                    if size > _CODES or spelt > _SPELT:
                        size, total = 0, fold()
                        if len(names) > _NAMES or spelt > _SPELT:
                            yield from rows()
                            spelt, total = 0, np.zeros(0, np.int64)
            if codes:
                total = fold()
            if names:
                yield from rows()

        made = texts.mapInPandas(count, "h long, lang string, word string, n long")
        # By the number alone, so that words of one number meet.
        merged = made.repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
        merged = merged.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("h")))
        return stored(merged.filter(F.col("word").isNull() | (F.col("n") >= fewest)))

    for seed in range(8):
        words = counted(seed)
        if words.filter("word is not null and same > 1").isEmpty():
            return words.drop("same"), seed
    raise ValueError("words share their hashes by every seed")


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` by the keys, in their order; there is at least one row."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    first = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    return (*[k[first] for k in keys], np.add.reduceat(n, first))


@dataclass
class _Tally:
    """Counts of one task, of phrases of ``size`` words whose parts may be frequent."""

    size: int
    known: list[Known]
    hashes: list = field(default_factory=list)
    langs: dict = field(default_factory=dict)
    codes: list = field(default_factory=list)
    held: list = field(default_factory=list)
    n_codes: int = 0

    def add(self, lang: str, text: str) -> None:
        if lang not in self.langs:
            self.langs[lang] = _Codes(lang, self.hashes, self.known[0])
        self.codes.append(codes_of(text, self.langs[lang]))
        self.n_codes += len(self.codes[-1])
        if self.n_codes > _CODES:
            self.fold()

    def fold(self) -> None:
        """Adds the phrases of the codes at hand, as one or two numbers of two words each."""
        if not self.codes:
            return
        c = np.concatenate(self.codes)
        self.codes, self.n_codes = [], 0
        m = len(c) - self.size + 1
        if m < 1 or not self.hashes:
            return
        take = np.logical_and.reduce([c[i : i + m] >= 0 for i in range(self.size)])
        if self.size > 2:
            word = np.fromiter(self.hashes, np.uint64, len(self.hashes))[np.maximum(c, 0)]
            part = self.known[self.size - 2].test([word[i : i + m + 1] for i in range(self.size - 1)])
            take &= part[:-1] & part[1:]
        at = np.flatnonzero(take)
        if not len(at):
            return
        keys = [c[at] << 32 | c[at + 1]]
        if self.size > 2:
            keys.append(c[at + 2] << 32 | (c[at + 3] if self.size > 3 else 0))
        self.held.append(_summed(keys, np.ones(len(at), np.int64)))
        if sum(len(x[0]) for x in self.held[1:]) > _ENTRIES:
            self.merge()

    def merge(self) -> None:
        *keys, n = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held = []  # freed before the sort takes its copies
        self.held = [_summed(keys, n)]

    @property
    def full(self) -> bool:
        return sum(len(x[0]) for x in self.held[:1]) > _HASHES or len(self.hashes) > _NAMES

    def flush(self) -> Iterator[pd.DataFrame]:
        """Counts of all phrases so far; leaves nothing."""
        self.fold()
        if self.held:
            self.merge()
            word = np.fromiter(self.hashes, np.uint64, len(self.hashes)).view(np.int64)
            *keys, n = self.held[0]
            for i in range(0, len(n), 1 << 16):
                codes = [x for k in keys for x in (k[i : i + (1 << 16)] >> 32, k[i : i + (1 << 16)] & 0xFFFFFFFF)]
                yield pd.DataFrame({w: word[codes[j]] if j < self.size else 0 for j, w in enumerate(_IDS)} | {"n": n[i : i + (1 << 16)]})
        self.held, self.langs = [], {}
        self.hashes.clear()


def id_counts(texts: DataFrame, size: int, known: list[Known], fewest: int) -> DataFrame:
    """(w1, w2, w3, w4, n): phrases of ``size`` words, as numbers of words, that occur ``fewest`` times or more. Stored.

    ``known`` has a bitmap for each smaller size; a phrase counts if its words and its parts of one word less may be frequent.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = _Tally(size, shared.value)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                tally.add(lang, text)
                if tally.full:
                    yield from tally.flush()
        yield from tally.flush()

    made = texts.mapInPandas(count, ", ".join(f"{w} long" for w in [*_IDS, "n"]))
    return stored(made.groupBy(*_IDS).agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest))


def _known(found: DataFrame, size: int, seed: int) -> Known:
    """The bitmap of counted words or phrases."""
    words = [F.col(w) for w in _IDS[:size]] if size > 1 else [F.col("h")]
    some = found if size > 1 else found.filter("word is not null")
    return Known(size, bitmap(some.select(_mixed_column(words).alias("h"))), seed)


def likely(texts: DataFrame, fewest: int, sizes: tuple[int, ...], known: list[Known]) -> list[Known]:
    """Bitmaps of the phrases of each of ``sizes`` words that occur ``fewest`` times or more; ``known`` has those of all smaller sizes."""
    made = list(known)
    for size in sizes:
        found, seed = word_counts(texts, fewest) if size == 1 else (id_counts(texts, size, made, fewest), made[0].seed)
        made.append(_known(found, size, seed))
    return made[len(known) :]


def _spelt(found: DataFrame, words: DataFrame, size: int, few: bool) -> DataFrame:
    """(size, lang, prefix, next, n) of counted phrases of ``size`` words, all of which are frequent words."""
    for i, w in enumerate(_IDS[:size]):
        named = words.select(F.col("h").alias(w), F.col("word").alias(f"_{w}"), *(["lang"] if not i else []))
        found = found.join(F.broadcast(named) if few else named.hint("merge"), w)
    spelt = [f"_{w}" for w in _IDS[:size]]
    return found.select(F.lit(size - 1).alias("size"), "lang", F.concat_ws(" ", *spelt[:-1]).alias("prefix"), F.col(spelt[-1]).alias("next"), "n")


def stripes(texts: DataFrame, sizes: tuple[int, ...], known: list[Known], fewest: int) -> DataFrame:
    """(size, lang, prefix, next, n): merged entries of at least ``fewest`` for prefixes of each of ``sizes`` words and,
    with a null next word, totals of single words; of size 0, the words of each language. Stored.
    ``known`` may give bitmaps for each size from one word on; others are made of the counts.
    """
    words, seed = word_counts(texts, fewest)
    known = [k for k in known if k.seed == seed] or [_known(words, 1, seed)]
    named = words.filter("word is not null")
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    size = F.when(F.col("word").isNull(), 0).otherwise(1).alias("size")
    rows = words.select(size, "lang", F.col("word").alias("prefix"), F.lit(None).cast("string").alias("next"), "n")
    for n_words in range(2, max(sizes) + 2):
        if n_words - 1 not in sizes and len(known) >= n_words:
            continue
        found = id_counts(texts, n_words, known, fewest)
        if n_words - 1 in sizes:
            rows = rows.unionByName(_spelt(found, named, n_words, few))
        if len(known) < n_words <= max(sizes):
            known.append(_known(found, n_words, seed))
    return stored(rows)


def _tail(phrase: Column | str) -> Column:
    """A phrase without its first word."""
    return F.regexp_replace(phrase, "^[^ ]* ", "")


def phrase_counts(docs: DataFrame, fewest: int = FEWEST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f, longer) of all phrases of at least ``fewest``, and (lang, n).

    ``longer`` is the largest count among phrases that hold the phrase and one word more.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases of up to 2, 3 or 4 words")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stripes(texts, tuple(range(1, longest)), [], fewest)
    sums = rows.filter("size = 0").select("lang", "n")
    phrase = F.concat_ws(" ", "prefix", "next").alias("phrase")
    words = rows.filter("size = 1 and next is null").select("lang", "size", F.col("prefix").alias("phrase"), F.col("n").alias("f"))
    entries = rows.filter("size > 0 and next is not null").select("lang", "size", "prefix", phrase, "n")
    counts = words.unionByName(entries.select("lang", (F.col("size") + 1).alias("size"), "phrase", F.col("n").alias("f")))
    held = entries.filter("size > 1")
    held = held.select("lang", F.col("prefix").alias("phrase"), "n").unionByName(held.select("lang", _tail("phrase").alias("phrase"), "n"))
    most = held.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return stored(counts.join(most, ["lang", "phrase"], "left").select("lang", "size", "phrase", "f", "longer")), sums


def collocations(docs: DataFrame, fewest: int = FEWEST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each language.

    Words are what blanks and tabs separate inside pieces, which end at ``.,;:!?`` and
    line breaks; A-Z are lower-cased. A phrase of two to ``longest`` words, found a >=
    ``fewest`` times, is cut where 2a / (l + r) is lowest, of l and r occurrences of its
    parts; phrases of which a longer one has 80 % or more are left out. Null texts are
    empty, a null language is ``und``; empty texts and empty tables give nothing,
    repeated rows count as often as they occur, texts of any length are read whole and
    other columns are ignored. Counts and products are exact.
    """
    counts, sums = phrase_counts(docs, fewest, longest)
    kept = counts.filter("size > 1").filter(F.col("longer").isNull() | (100 * F.col("longer") < SUBSUMED * F.col("f")))
    w = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice(w, F.lit(1), k), " ").alias("first"),
            F.array_join(F.slice(w, k + 1, F.col("size") - k), " ").alias("last"),
        ),
    )
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = counts.filter(F.col("size") < longest).select("lang", F.col("phrase").alias("part"), "f")
    few = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for name, side in (("l", "first"), ("r", "last")):
        known = parts.select(F.col("lang").alias("_lang"), F.col("part"), F.col("f").alias(name))
        known = F.broadcast(known) if few else known.hint("merge")
        cuts = cuts.join(known, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("part"))).drop("_lang", "part")
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE}BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    rows = lowest.select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    # One row per language; Spark sees the size of the stored counts.
    return rows.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
