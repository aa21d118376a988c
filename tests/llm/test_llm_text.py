"""Decontamination, SimHash, classifiers and neighbours on small hard cases, against plain Python."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import ann, connected, decontaminate, quality, simhash, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def contaminated(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for s in range(max(len(b) - n, 0) + 1 if b else 0):
            win = b[s : s + n]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [
    (1, LINE), (2, "Short item"), (3, "one"), (4, "the the the the the the the the the the the the"), (5, None),
    (6, "..."), (7, "École ÉTÉ d'été à la plage de sable fin tout près ici"), (2, "again two words"), (None, "nobody owns this"),
]
TEXTS = [
    (1, f"x {LINE.upper()}, y"), (2, LINE.replace("mu", "nu")), (3, "kappa " + LINE.rsplit(" ", 3)[0]), (4, None), (5, ""),
    (6, "a SHORT--item here short item"), (7, "the " * 40), (8, "École ÉTÉ d'été à la plage de sable fin tout près ici"),
    (9, "école été d'été à la plage de sable fin tout près ici"), (10, "One"), (11, ", one"), (12, "one,"), (13, "nobody owns this"),
    (14, "pad " * 20_000 + LINE + " pad" * 20_000), (1, "same id, other text: short item"), (None, "Short item"), (6, "a SHORT--item here short item"),
]


def test_decontamination_against_plain_python(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, TEXTS).withColumn("items", F.lit("mine"))
    got = decontaminate.decontaminate(docs, items).collect()
    want = sorted(repr((i, *contaminated(t, ITEMS))) for i, t in TEXTS)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_decontamination_with_a_window_of_many_items(spark):
    """A window that a thousand items share is one window: rows that tests make do not multiply."""
    items = [(i, f"{LINE} own{i} word{i}") for i in range(1000)]
    texts = [(i, f"a b {LINE} c {LINE} d{i}" + (f" {LINE} own{i} word{i}" if i % 2 else "")) for i in range(40)]
    docs, table = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    windows = decontaminate.stored(decontaminate.item_windows(table, 10))
    assert decontaminate.find_windows(docs, windows).count() == 40 * 2 * 3 + 20 * 5
    got = {r["doc_id"]: (r["n_hit"], len(r["items"])) for r in decontaminate.decontaminate(docs, table).collect()}
    assert got == {i: (38 if i % 2 else 24, 1000) for i in range(40)}


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, TEXTS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    clean = decontaminate.decontaminate(docs, items.limit(0))
    assert (clean.count(), clean.filter("contaminated").count()) == (len(TEXTS), 0)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    spans = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def linked(fps, radius=3):
    """Component of each position, as its smallest position."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_spark_xxhash_of_shingles():
    for text in ["", " \t\n", "One", "a B", "a b c", "É é\u00a0x Y z", "w " * 100_000, "x\x0by\x0cz\x1cw q"]:
        assert simhash.fingerprint_of(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    rng = np.random.default_rng(0)
    for n in (1, 2, 3):
        for _ in range(3000):
            diff = sum(1 << int(b) for b in rng.choice(64, n, replace=False))
            assert any(diff & m & (1 << 64) - 1 == 0 for m in masks)


@pytest.mark.parametrize("most", [2, 8, 16_384])
def test_near_duplicates_in_dense_groups(spark, most):
    """Chains and balls of fingerprints, in buckets of any size, give the components of all pairs."""
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(6):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            fps.add(at)
            at ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = connected.components(simhash.bucket_links(classes, 3, most))
    roots = {r["node"]: r["root"] for r in found.collect()}
    got = [fps.index(roots.get(f, f)) for f in fps]
    assert got == linked([f & (1 << 64) - 1 for f in fps])


DUPS = [(i, t) for i, t in enumerate(
    ["a b c d e", "A b c d e", None, "", "  ", "lone text of five", "long " * 5000 + "x", "long " * 5000 + "y"]
)] + [(5, "lone text of five"), (None, "no id at all here"), (None, "no id at all here"), (None, "a b c d e"), (5, "other text under id five")]


def test_near_duplicates_with_nulls_and_repeats(spark):
    got = simhash.near_duplicates(docs_of(spark, DUPS).withColumn("fp", F.lit("x"))).collect()
    fps = [plain_fingerprint(t) for _, t in DUPS]
    groups = linked(fps)
    want = []
    for (i, _), fp, g in zip(DUPS, fps, groups, strict=True):
        ids = [DUPS[j][0] for j in range(len(DUPS)) if groups[j] == g and DUPS[j][0] is not None]
        want.append((i, fp, min(ids, default=None)))
    assert sorted(repr((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"])) for r in got) == sorted(map(repr, want))
    kept = simhash.keep_first(docs_of(spark, DUPS)).collect()
    assert len(kept) == len(set(groups))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.keep_first(docs_of(spark, [])).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in connected.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(60)}
    assert connected.components(spark.createDataFrame([], "a long, b long")).count() == 0


def best_runs(scores):
    """Maximal-scoring runs by their definition: the best run, then the same left and right of it."""
    best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
               key=lambda t: (round(t[0], 9), -(t[2] - t[1])), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, a, b = best
    right = [(x + b, y + b, s) for x, y, s in best_runs(scores[b:])]
    return [*best_runs(scores[:a]), (a, b, best[0]), *right]


def test_maximal_runs_against_their_definition():
    rng = np.random.default_rng(1)
    for _ in range(150):
        scores = np.round(rng.normal(-0.2, 1.0, int(rng.integers(0, 25))), 3)
        got = toxicity.maximal_runs(scores)
        want = best_runs(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def accuracy(scored, labels, column):
    both = scored.join(labels, "doc_id").filter(F.col("held_out"))
    return both.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert accuracy(quality.classify(docs, labels), labels, "quality") >= 0.98
    assert accuracy(toxicity.score_toxicity(docs, labels), labels, "toxic") >= 0.97


def test_classifiers_on_hard_rows(spark):
    rows = [(i, "calm words only here now" if i % 3 else "you utter fool and knave") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "calm " * 60_000), (None, "calm words"), (5, "calm words only here now")] * 2
    docs = docs_of(spark, rows).withColumns({"score": F.lit("x"), "predicted": F.lit(9), "passages": F.lit(1)})
    marks = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(300)] + [(None, 1, 0), (3, None, None), (1000, 1, 0), (4, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for scored, column in ((quality.classify(docs, labels), "quality"), (toxicity.score_toxicity(docs, labels), "toxic")):
        got = scored.toPandas()
        assert len(got) == len(rows)
        assert got["score"].between(0, 1).all()
        assert accuracy(scored, labels.filter("doc_id < 300 and doc_id <> 4"), column) >= 0.95
        assert (got["predicted"] == (got["score"] >= (0.7 if column == "quality" else 0.5))).all()
    empty = docs.limit(0)
    assert quality.classify(empty, labels).count() == toxicity.score_toxicity(empty, labels).count() == 0
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4]
    out = {}
    for q in {i for i, _ in fine if i % 100 == 0}:
        near = {}
        for i, v in fine:
            if i != q:
                near[i] = min(near.get(i, np.inf), min(float(np.sqrt(((v - w) ** 2).sum())) for j, w in fine if j == q))
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def test_neighbours_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(330)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(600, 660)] + [(700, rows[3][1]), (3, rows[3][1]), (100, [9.0, 9.0, 9.0, 9.0])]
    rows += [(800, None), (801, [0.0] * 4), (802, [1.0, None, 2.0, 3.0]), (900, [float("nan"), 1.0, 1.0, 1.0]), (804, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (805, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got: dict = {}
    found = ann.nearest(df, F.col("id") % 100 == 0, k=10, curves=ann.Curves(recall=1.0, trials=400, block=64))
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute(rows, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]])
    assert ann.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0
    few = ann.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 100 == 0)
    assert [(r["query_id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_neighbours_where_ids_have_many_near_vectors(spark):
    """One id, the query's own id and a pair of ids with the same vectors must not take the places of others."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    at = np.array(rows[0][1])
    for i in (0, 7):
        rows += [(i, (at + 0.01 * rng.normal(size=4)).tolist()) for _ in range(30)]
    for _ in range(20):
        v = (at + 0.02 * rng.normal(size=4)).tolist()
        rows += [(8, v), (9, v)]
    rows += [(i, rows[70][1]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    found = ann.nearest(df, F.col("id") % 100 == 0, curves=ann.Curves(recall=1.0, trials=400, block=16))
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for _, i in w] for q, w in brute(rows, 10).items()}


@pytest.mark.parametrize("case", ["near copies", "outlier"])
def test_neighbours_among_thousands_of_near_copies_and_beside_an_outlier(spark, case):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(3000, 16))
    if case == "near copies":
        m[:2500] = m[0] + 0.001 * rng.normal(size=(2500, 16))
    else:
        m[-1] *= 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    curves = ann.Curves(recall=1.0, sample=3000, trials=3000 if case == "outlier" else 96)
    got = ann.nearest(df, F.col("id") % 100 == 0, curves=curves).toPandas()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits >= 0.95 * 300


def test_hilbert_curve_visits_neighbouring_cells():
    bits, d = 3, 3
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.nearest(df, F.col("id") % 100 == 0).toPandas()
    table = df.toPandas()
    m, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9
