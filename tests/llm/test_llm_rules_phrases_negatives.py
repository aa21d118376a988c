"""Quality rules, collocations and hard negatives on small hard cases, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import negatives, phrases, rules

DOC = "doc_id long, text string, lang string, source string, n_words string"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def quality_corpus():
    """Rows of two languages, one with too few labels, with junk that symbols and word lengths give away."""
    source, rows, labels = random.Random(3), [], []
    for i in range(1500):
        lang = "en" if i % 3 else "fr" if i % 2 else None
        n, bad = source.randrange(51, 120), i % 7 == 0
        words = ["".join(source.choices("abcdefg", k=source.randrange(3, 8))) for _ in range(n)]
        if bad:
            words = [w + "|" for w in words] if i % 2 else [w * 3 for w in words]
        elif source.random() < 0.05:
            words[3] = "#tag"
        rows.append((i, " ".join(words), lang, "s", "mine"))
        if lang == "en" or i % 30 == 0:
            labels.append((i, 0 if bad else 1, 0))
    hard = [None, "", " \n\t ", "a a a a a", "x y z " * 40, "one two\n" * 30 + "\n \n" + "one two \n", "ü€ 𝄞 <b>&", "w " * 30_000, "z" * 300_000,
            "\x1c odd \xa0blank " + " ".join(f"k{i}" for i in range(60)), "a b c d a b c d b c d a " * 5]
    rows += [(2000 + i, t, "en", None, None) for i, t in enumerate(hard)] + [(None, "no id", None, None, None), rows[0], rows[0]]
    return rows, labels + [(2004, None, 0), (None, 1, 0), (3, 1, 0), (3, 0, 0)]


def test_rules_against_plain_python(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows, DOC)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rules.judge(docs, marked).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t, *_ in rows:
        by_id[i].append(counts(t))
    for r in got:
        want = by_id[r["doc_id"]][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])

    # The method itself, on the labelled rows that pass the base rule.
    def values(c):
        length = min(c[1] * 100 // c[0], 10_000)
        return c[2] * 10_000 // c[1], c[3] * 10_000 // c[5], c[4] * 10_000 // c[0], length, 10_000 - length

    label = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            label[i] = max(q, label.get(i, 0))
    risk, rungs = 0.02, (0, 1, 2, 3, 5, 8, 12, 20)
    proposals, holdout = defaultdict(list), defaultdict(list)
    for i, t, lang, *_ in rows:
        c = counts(t)
        if i in label and not (c[0] < 50 or 100 * c[4] > 50 * c[0]):
            half = int(hashlib.md5(str(i).encode()).hexdigest()[0], 16) % 2
            (holdout if half else proposals)[lang].append((values(c), label[i]))
    strata = [s for s in holdout if any(y for _, y in holdout[s])]
    chosen = {}
    for s in strata:
        good = [v for v, y in proposals[s] if y]
        bad = [v for v, y in proposals[s] if not y]
        ladder = {}
        for k in range(5):
            cut = [min(x[k] for x in good if sum(v[k] > x[k] for v in good) * 1000 <= j * len(good)) for j in rungs] if good else []
            if cut and sum(v[k] > cut[-1] for v in bad) * len(good) > sum(v[k] > cut[-1] for v in good) * len(bad):
                ladder[k] = cut
        rung = lambda v, ladder=ladder: min([next((j for j in range(8) if v[k] > c[j]), 99) for k, c in ladder.items()], default=99)
        tested = [rung(v) for v, y in holdout[s] if y]
        n, sums, most = len(tested), 0.0, -1
        for k in range(math.ceil(n * risk) + 1):
            sums += math.comb(n, k) * risk**k * (1 - risk) ** (n - k)
            most = k if sums <= 0.05 / len(strata) else most
        passed = [(sum(rung(v) <= j for v in bad), -j) for j in range(8) if sum(x <= j for x in tested) <= most]
        chosen[s] = (rung, -max(passed)[1]) if passed else None
    assert chosen["en"] is not None and chosen[None] is None
    lang_of = {(i, t): lang for i, t, lang, *_ in rows}
    text_of = {i: t for i, t, *_ in rows}
    rejected = 0
    for r in got:
        pick = chosen.get(lang_of[r["doc_id"], text_of[r["doc_id"]]])
        by_method = bool(pick) and not r["base_failed"] and pick[0](values(counts(text_of[r["doc_id"]]))) <= pick[1]
        rejected += by_method
        assert r["kept"] == (not r["base_failed"] and not by_method), r["doc_id"]
    assert rejected > 90


@pytest.mark.parametrize("n", [1, 50, 228, 5000, 200_000])
def test_critical_count_is_the_exact_binomial_bound(spark, n):
    got = spark.range(1).select(rules.critical_count(F.lit(n).cast("long"), 0.02, F.lit(math.log(0.01)))).first()[0]
    log_pmf = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.02) + (n - k) * math.log(0.98)
    total, most = 0.0, -1
    for k in range(math.ceil(n * 0.02) + 1):
        total += math.exp(log_pmf(k))
        most = k if total <= 0.01 else most
    assert got == most


def test_certified_cutoffs_rarely_lose_more_than_the_risk(spark):
    """Fresh good rows of the law that the labelled ones came from: over 40 strata, a bound of 5 % in all."""
    made = spark.range(120_000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 40).cast("string").alias("stratum"), F.lit(100).cast("long").alias("n_words"),
        F.lit(500).cast("long").alias("word_chars"), F.expr("pmod(xxhash64(id, 5), 250)").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"),
        F.expr("pmod(xxhash64(id, 6), 40)").alias("n_repeat_words"), F.lit(1).cast("long").alias("n_lines"), F.lit(False).alias("base_failed"))
    labels = made.select("doc_id", F.when(F.col("doc_id") % 60 < 40, 1).otherwise(0).alias("quality"))
    made = made.withColumn("n_symbols", F.when(F.col("doc_id") % 60 < 40, F.col("n_symbols")).otherwise(F.col("n_symbols") + 200))
    model = rules.fit_cutoffs(made, labels, rules.Risk(risk=0.05)).collect()
    lost = [sum(s * 20 > r["cutoff"]["symbols"] for s in range(250)) / 250 for r in model if r["rung"] is not None and r["cutoff"]["symbols"] is not None]
    assert len(lost) > 20 and sum(x > 0.05 for x in lost) == 0


def test_rules_of_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judge(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "w " * 60 + " ".join(f"x{i}" for i in range(80)), "en", "s", "")], DOC)
    assert [r["kept"] for r in rules.judge(one, labels).collect()] == [True]


def phrases_of(rows, fewest, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= fewest}
        rows = []
        for p, a in some.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(100 * b >= 80 * a for q, b in some.items() if inside(q)):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        for i, (s, _, p, a, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), a, left, right, n[lang], -s))
    return sorted(out)


def test_collocations_against_plain_python(spark, monkeypatch):
    source = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["ÉTÉ", "été", "The", "\x1codd", "a\xa0b", "𝄞"]
    rows = []
    for _ in range(400):
        words = source.choices(vocabulary, weights=[40 / (i + 1) for i in range(len(vocabulary))], k=source.randrange(0, 60))
        if source.random() < 0.4:
            at = source.randrange(len(words) + 1)
            words[at:at] = source.choice([["new", "york", "city", "hall"], ["new", "york"], ["a", "a", "a", "a", "a"], ["Status", "quo", "ante"]])
        rows.append((source.choice([" ", "\t", "  "]).join(w + source.choice(["", "", "", "", ",", ".", "\r\n"]) for w in words), source.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), (" ., ", "xx"), ("lonely", "yy"), ("hot " * 40_000, "en"), ("y" * 200_000, "en")] + [rows[0]] * 9
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "text string, lang string, prefix string, n int")
    for chunk, entries, top in ((1 << 20, 1 << 21, 2000), (64, 128, 7)):
        # Small bounds: texts are cut, tallies folded and flushed many times.
        monkeypatch.setattr(phrases, "_CHUNK", chunk)
        monkeypatch.setattr(phrases, "_ENTRIES", entries)
        monkeypatch.setattr(phrases, "_CODES", entries)
        monkeypatch.setattr(phrases, "_HASHES", entries)
        got = sorted(map(tuple, phrases.collocations(docs, fewest=12, top=top).collect()))
        assert got == phrases_of(rows, 12, 4, top)
    got = sorted(map(tuple, phrases.collocations(docs, fewest=12, longest=2).collect()))
    assert got == phrases_of(rows, 12, 2, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_a_full_bitmap_changes_no_result(spark):
    texts = spark.createDataFrame([(f"t{i % 11} t{i % 7} t{i % 5} t{i % 3} t{i % 2}", "en") for i in range(3000)], "text string, lang string")
    known = phrases.likely(texts, 30, (1, 2), [])
    full = [phrases.Known(k.size, phrases.Bits(np.full_like(k.bits.table, 255), k.bits.shift)) for k in known]
    narrow, wide = (sorted(map(repr, phrases.stripes(texts, (1, 2), k, 30).collect())) for k in (known, full))
    assert narrow == wide and len(narrow) > 50
    assert min(k.bits.table.size for k in known) == 1 << 13


def test_each_phrase_is_handed_on_once(spark):
    """The total of a pair is an entry of its first word; only single words have totals."""
    texts = spark.createDataFrame([(f"t{i % 11} t{i % 7} t{i % 5} t{i % 3}", "en") for i in range(3000)], "text string, lang string")
    known = []
    for size in (1, 2, 3):
        known += phrases.likely(texts, 30, (size,), known)
    made = phrases.stripes(texts, (1, 2, 3), known, 1).filter("size > 0").collect()
    spelt = [r["prefix"] if r["next"] is None else f"{r['prefix']} {r['next']}" for r in made]
    assert len(spelt) == len(set(spelt)) and {r["size"] for r in made if r["next"] is None} == {1}
    want = Counter()
    for i in range(3000):
        w = [f"t{i % k}" for k in (11, 7, 5, 3)]
        want.update(" ".join(w[a:b]) for a in range(4) for b in range(a + 1, 5))
    often = {p: n for p, n in want.items() if n >= 30}
    assert {p: r["n"] for p, r in zip(spelt, made, strict=True) if r["n"] >= 30} == often
    counts, _ = phrases.phrase_counts(texts)
    assert {r["phrase"]: r["f"] for r in counts.collect()} == often


def test_a_phrase_is_handed_on_in_one_reading_only(spark, monkeypatch):
    """One row per phrase and task, and one per task for all words of the language."""
    texts = spark.createDataFrame([("a b c d e, a b", "en")] * 320, "text string, lang string").repartition(8)
    handed, plain = spark.sparkContext.accumulator(0), type(texts).mapInPandas

    def counted(self, func, schema, *more):
        def rows(batches):
            for made in func(batches):
                handed.add(len(made))
                yield made

        return plain(self, rows, schema, *more)

    monkeypatch.setattr(type(texts), "mapInPandas", counted)
    counts, sums = phrases.phrase_counts(texts)
    assert {r["phrase"] for r in counts.collect()} == {"a b c d e"[i : i + 2 * n - 1] for n in range(1, 5) for i in range(0, 11 - 2 * n, 2)}
    assert [tuple(r) for r in sums.collect()] == [("en", 7 * 320)]
    assert handed.value == 8 * (5 + 4 + 3 + 2 + 1)


def test_words_that_share_a_hash_are_counted_by_another(spark, monkeypatch):
    rows = [(f"t{i % 11} t{i % 7}, rare{i} t{i % 5} t{i % 3}", source) for i in range(1500) for source in ("en", "de")]
    texts = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(map(tuple, phrases.collocations(texts).collect()))
    assert len(want) >= 30
    first = {xxhash.xxh64_intdigest(lang, 0) for lang in (b"en", b"de")}
    plain, made = phrases.word_counts, []

    def counts(texts, fewest):
        # By the first seed a frequent word shares its hash with a rare one.
        digest = lambda word, seed: 5 if seed in first and word in (b"t1", b"rare7") else xxhash.xxh64_intdigest(word, seed)
        made.append(plain(texts, fewest, digest))
        return made[-1]

    monkeypatch.setattr(phrases, "word_counts", counts)
    for bound in (1 << 20, 16):
        monkeypatch.setattr(phrases, "_NAMES", bound)
        monkeypatch.setattr(phrases, "_SPELT", bound)
        monkeypatch.setattr(phrases, "_CODES", bound)
        assert sorted(map(tuple, phrases.collocations(texts).collect())) == want
    assert [seed for _, seed in made] == [1, 1]
    for words, _ in made:
        got = {(r["lang"], r["word"]): r["n"] for r in words.collect()}
        often = Counter((lang, w) for text, lang in rows for w in text.replace(",", "").split())
        sums = Counter({lang: sum(n for (x, _), n in often.items() if x == lang) for lang in ("en", "de")})
        assert got == {k: n for k, n in often.items() if n >= 30} | {(lang, None): n for lang, n in sums.items()}


def mined(rows, anchors, positives=5, negatives_=5):
    rows = list({(i, lab, tuple(v)) for i, lab, v in rows})
    size = Counter(len(v) for *_, v in rows)
    width = min(size, key=lambda w: (-size[w], w))
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if len(v) == width]
    out = []
    for a, la, va in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in rows if i != a)
        for s, p, lab in [x for x in scored if x[2] == la][:positives]:
            fit = [(n, -t) for t, n, lb in scored if lb != la and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(fit[:negatives_], 1)]
    return sorted(out)


SMALL = negatives.Lists(members=4, part=3, head=16, segment=24, sample=64)


@pytest.mark.parametrize("sizes", [negatives.Lists(), SMALL])
def test_hard_negatives_against_plain_python(spark, sizes):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 8))
    rows = [(i, int(draw.integers(0, 4)), (centres[i % 6] * (i % 3 != 0) + draw.normal(size=8) * 0.3).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 3, [0.5] * 8) for i in range(60)]  # equal vectors of several labels: ties
    rows += [(2000 + i, i % 2, [0.0] * 8) for i in range(7)] + [(3000, 1, [1e6] * 8), (3001, 2, [-1e6] * 8)]
    rows += [rows[0], rows[10], (20, 3, [1.0] * 8), (20, 1, [0.5] * 8), (4000, 1, [1.0] * 5)]
    clean = list(rows)
    broken = [(5000, None, [1.0] * 8), (None, 1, [1.0] * 8), (5001, 1, None), (5002, 1, [None] + [1.0] * 7), (5003, 1, [math.nan] * 8),
              (5004, 1, [math.inf] * 8), (5005, 1, []), (5006, 1, [1e300] * 8)]
    df = spark.createDataFrame([(i, v, lab, "mine") for i, lab, v in rows + broken], "vec_id long, embedding array<double>, label int, score string")
    found = negatives.mine(df, F.col("id") % 10 == 0, sizes=sizes).collect()
    assert sorted(map(tuple, found)) == mined(clean, lambda i: i % 10 == 0)
    assert negatives.mine(df.limit(0), F.col("id") % 10 == 0, sizes=sizes).count() == 0


def test_clustered_vectors_are_read_only_to_the_bound(spark):
    """Members of tight clusters leave their lists early: tails bring few rows."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16))
    rows = [(i, int(draw.integers(0, 2)), (centres[i % 20] + draw.normal(size=16) * 0.02).tolist()) for i in range(4000)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id long, embedding array<double>, label int")
    sizes = negatives.Lists(members=2, head=400, sample=400)
    good = negatives.usable(df, "vec_id", "embedding", F.col("label"), 256)
    index, placed = negatives.build_index(good, good.filter("id % 100 = 0"), sizes)
    above = index.counts[:, ::-1].cumsum(1)
    assert (above[:, 0] <= above[:, -1]).all() and (above[:, -1] == 4000).all()
    asked = placed.withColumns({"low": F.array(F.lit(-(1 << 62))), "high": F.array(F.lit(1 << 62))})
    found = negatives.search(index, asked, 5, True)
    assert found.count() == 5 * 40
    labels = {i: lab for i, lab, _ in rows}
    want = {(a, n) for a, n, *_ in mined_positives(rows)}
    assert {(r["anchor"], r["id"]) for r in found.collect()} == want and all(labels[a] == labels[n] for a, n in want)


def mined_positives(rows):
    v = np.floor(256 * np.array([x for *_, x in rows])).astype(np.int64)
    lab = np.array([x for _, x, _ in rows])
    for i in range(0, len(rows), 100):
        s = v @ v[i]
        order = [j for j in np.lexsort((np.arange(len(rows)), -s)) if lab[j] == lab[i] and j != i][:5]
        yield from ((i, int(j)) for j in order)
