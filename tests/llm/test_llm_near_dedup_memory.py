"""What the near-duplicate stage holds at a time, in workers and in the driver."""

from __future__ import annotations

import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import bits, common, similar

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_workers_get_few_whole_texts_at_a_time(spark, monkeypatch):
    """Every reading of texts runs on small batches; the session's own setting returns, a smaller one holds."""
    held = {}

    def spy(df):
        held["+".join(df.columns)] = int(spark.conf.get(BATCH))
        return common.stored(df)

    monkeypatch.setattr(similar, "stored", spy)
    docs = spark.createDataFrame([(i, f"some words of a text that is told {i // 2} times") for i in range(8)], "doc_id long, text string")
    for own, most in ((None, common.TEXTS), ("0", common.TEXTS), ("7", 7)):
        held.clear()
        if own:
            spark.conf.set(BATCH, own)
        try:
            assert similar.keep_first_similar(docs).count() == 4
            assert spark.conf.get(BATCH, None) == own
        finally:
            spark.conf.unset(BATCH)
        assert {held[c] for c in ("k1+fp", "root+k1+k2+s+n+gid")} == {most}
    sizes = lambda batches: (b.head(1).assign(id=len(b)) for b in batches)
    with common.text_batches(spark):
        assert spark.range(0, 1000, 1, 1).mapInPandas(sizes, "id long").agg(F.max("id")).first()[0] == common.TEXTS


def test_remembered_words_are_bounded(spark):
    codes, words = similar._Codes(), [f"w{i}".encode() for i in range(100_000)]
    assert [codes[w] for w in words + words[:9]] == [xxhash.xxh64_intdigest(w, similar.SEED) for w in words + words[:9]]
    assert len(codes) <= 1 << 16


def test_rarity_by_parts_is_the_whole_count(spark, monkeypatch):
    monkeypatch.setattr(similar, "_PAGES", 3)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(50)]
    found = similar._rarity(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 5)
    shift, codes = np.uint64(65 - len(found).bit_length()), similar._Codes()
    n = np.zeros(len(found), np.int64)
    for t in texts:
        n[(similar.shingle_set(t, codes) >> shift).astype(np.int64)] += 1
    assert (found == np.where(n > 0, np.round(8 * np.log2(np.maximum(n, 1))) + 1, found[n == 0].max())).all() and found[n == 0].max() <= 1


def test_bitmap_takes_little_of_the_driver(spark):
    hashes = common.stored(spark.range(200_000).select(F.xxhash64("id").alias("h")))
    spark.range(1).toArrow()
    tracemalloc.start()
    found = bits.bitmap(hashes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * found.table.nbytes // 8 + (4 << 20)
    own = np.array([r["h"] for r in hashes.collect()])
    assert found.test(own).all() and np.bitwise_count(found.table).sum() == len(np.unique(own.view(np.uint64) >> np.uint64(found.shift)))
    assert not bits.bitmap(hashes.limit(0)).table.any()


def test_texts_stay_where_few_are_dropped(spark, monkeypatch, capsys):
    """Few keys are broadcast to the texts, many shuffled with them; both keep the same rows."""
    rows = [(i // 3, f"some words of a text that is told {i % 4} times") for i in range(24)] + [(None, None), (None, ""), (7, None)]
    docs = common.stored(spark.createDataFrame(rows + rows[:5], "doc_id long, text string"))
    kept, plans = [], []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (similar.BROADCAST_ROWS, 0):
            monkeypatch.setattr(similar, "BROADCAST_ROWS", most)
            found = similar.keep_first_similar(docs)
            found.explain()
            plans.append(capsys.readouterr().out)
            kept.append(sorted(str(r) for r in found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept[0] == kept[1] and len(kept[0]) == 5
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]


def _near_copies(source, many):
    """Texts of random words, some of them near copies, all of them with a few of the same stock phrases."""
    stock, texts = [" ".join(f"s{source.randrange(9)}" for _ in range(7)) for _ in range(30)], []
    for i in range(many):
        size = source.choice([5, 6, 9, 30, 100, 300])
        base = [f"w{source.randrange(10**6)}" for _ in range(size)]
        for _ in range(size // 12):
            base[source.randrange(size)] = source.choice(stock)
        for edits in source.choice([(0,), (0,), (0, 1), (0, size // 50 + 1, size // 30), (size // 25, size // 20)]):
            copy = base.copy()
            for at in source.sample(range(size), edits):
                copy[at] = f"e{source.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def _partners(texts, least=0.8):
    """The texts that another text, not a copy, is near."""
    sets = []
    for x in texts:
        w = x.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= round(10 * least) * len(sets[a] | sets[b])
    return {texts[i] for i in range(len(texts)) if any(texts[i] != texts[j] and near(i, j) for j in range(len(texts)))}


def test_counts_beyond_a_tasks_counters_add_up(spark, monkeypatch):
    texts = spark.createDataFrame([("the same five words here",)] * 900 + [("and five words of another",)] * 5, "text string").coalesce(1)
    found = []
    for most in ((1 << 16) - 1, 7):
        monkeypatch.setattr(similar, "_MOST", most)
        found.append(similar._rarity(texts, 5))
    assert (found[0] == found[1]).all() and set(found[0].tolist()) == {0, 80, 20}


@pytest.mark.parametrize("held", [1, 1 << 19])
def test_texts_without_partner_go_no_further(spark, monkeypatch, held):
    """No text that has a partner is lost, though every text shares shingles with many; nearly all others go, copies too."""
    monkeypatch.setattr(similar, "_HELD", held)
    texts = _near_copies(random.Random(3), 400) + ["", " ", "lone", "five words that are alone", "six words that are not alone", "Six words that are NOT alone"]
    docs = spark.createDataFrame([(x,) for x in texts + texts[::3]], "text string").repartition(5)
    named = common.stored(docs.select(*similar.text_keys(), "text"))
    t, want, alike = Fraction("0.8"), _partners(texts), _partners(texts, 0.2)
    for table in (np.zeros(1 << 16, np.uint8), similar._rarity(named, 5)):
        found = {r["h"] for r in similar._partnered(named, table, t, 5).collect()}
        kept = {r["text"] for r in named.collect() if r["k1"] >> 24 << 24 in found}
        assert want <= kept and len(kept - alike) <= 12 < len(want) and len(alike) < len(set(texts)) / 1.5
    assert similar._partnered(named.limit(0), table, t, 5).count() == 0


def test_longer_prefixes_share_what_is_asked_for():
    """Two sets of the least similarity, their own shingles first in the order, still share it."""
    t = Fraction("0.8")
    for n in range(1, 400):
        for m in range(n, n * 5 // 4 + 1):
            both = -(-4 * (n + m) // 9)
            if both > n:
                continue
            (one, need), (two, ask) = similar._longer(n, t), similar._longer(m, t)
            least = min(one - (n - both), two - (m - both))
            assert 1 <= max(need, ask) <= least and one <= n and two <= m


def test_coarse_counters_link_no_strangers(spark, monkeypatch):
    """With one page of counters every shingle looks alike: only texts that may have partners are candidates, and the result stays."""
    monkeypatch.setattr(similar, "COUNTERS", 12)
    monkeypatch.setattr(similar, "FINER", 12)
    texts = sorted(set(_near_copies(random.Random(5), 300)))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    named = common.stored(docs.select(*similar.text_keys(), "text"))
    linked = {x for r in similar._candidates(named, Fraction("0.8"), 5).collect() for x in (r["a"], r["b"])}
    found = {r["text"] for r in named.collect() if r["k1"] in linked}
    assert _partners(texts) <= found and len(found - _partners(texts, 0.2)) <= 12
    monkeypatch.undo()
    kept = sorted(r["doc_id"] for r in similar.keep_first_similar(docs).collect())
    for k, v in (("COUNTERS", 12), ("FINER", 12), ("_HELD", 50)):
        monkeypatch.setattr(similar, k, v)
    assert sorted(r["doc_id"] for r in similar.keep_first_similar(docs).collect()) == kept
