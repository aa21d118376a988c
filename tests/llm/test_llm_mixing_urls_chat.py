"""Mixing, URL rules and chat formatting on small hard cases, against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskflow.llm import bloom, chat, common, mixing, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOC)


def by_hand(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_targets_match_resharing_by_hand(spark):
    sizes = {"a": 10, "b": 1000, "c": 7, "d": 0, None: 400, "e": 55}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), (3, 2), 2).collect()}
    want = by_hand(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_comes_near_its_targets_and_keeps_every_row(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 3}" if i % 5 else None) for i in range(3000)]
    rows += [(7, "w " * 7, "s1")] * 5 + [(None, "x y", "s0"), (None, None, None), (3001, "", "s2")]
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    assert len(got) == len(rows)
    assert (got["taken"] <= 2 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    for _, part in got.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 120
        assert part["size"].sum() == part["source_size"].iloc[0]
    again = mixing.mix(docs_of(spark, rows).repartition(5)).toPandas()
    order = ["source", "doc_id", "size", "taken"]
    assert got[order].sort_values(order).values.tolist().__repr__() == again[order].sort_values(order).values.tolist().__repr__()


def test_smaller_budgets_are_contained_in_larger_ones(spark):
    docs = docs_of(spark, [(i, "w " * (1 + i % 9), f"s{i % 2}") for i in range(400)])
    low = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=(1, 2)).collect()}
    high = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=(5, 4)).collect()}
    assert all(low[i] <= high[i] for i in low)
    assert sum(low.values()) < sum(high.values())


def test_mix_of_nothing_and_of_no_words(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    got = mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_mix_copies_wordless_documents_no_more_than_others(spark):
    docs = docs_of(spark, [(i, "" if i % 2 else "a b", "s") for i in range(200)] + [(500, "a " * 10_000, "t")])
    got = {(r["source"], r["copies"]) for r in mixing.mix(docs, share=(2, 1)).collect()}
    assert got == {("s", 2), ("t", 2)}


def test_mix_replaces_clashing_columns_and_repeats_copies(spark):
    docs = docs_of(spark, [(i, "a b c", "s") for i in range(10)]).withColumn("size", F.lit("x"))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*DOC_COLUMNS, "size", "source_size", "target", "copies", "taken"]
    assert mixing.repeat_copies(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_attach_gives_the_same_rows_by_broadcast_and_by_shuffle(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 7), ("z", 1)], "k string, v long")
    few = spark.createDataFrame([("a", 1), (None, 2)], "k string, x long")
    for limit, node in ((0, "SortMergeJoin"), (10, "BroadcastHashJoin")):
        got = common.attach(rows, few, "k", limit=limit)
        counted = {(r["k"], r["x"], r["count"]) for r in got.groupBy("k", "x").count().collect()}
        assert counted == {("a", 1, 50), (None, 2, 1), ("z", None, 1)}
        assert got.columns == ["k", "v", "x"]
        assert node in got._jdf.queryExecution().executedPlan().toString()


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.xxhash64("key") % 7 == 0).unionByName(spark.createDataFrame([("k1",), (None,)], "key string"))
    # Far too few bits, so that several levels are needed.
    cascade = bloom.build_cascade(listed, universe.unionByName(universe), first_bits=1, next_bits=2)
    assert len(cascade.levels) > 3
    got = {r["key"] for r in universe.filter(cascade.contains("key")).collect()}
    assert got == {r["key"] for r in listed.collect()} - {None}
    empty = bloom.build_cascade(listed.limit(0), universe)
    assert universe.filter(empty.contains("key")).count() == 0
    nulls = spark.createDataFrame([(None,)], "key string")
    assert nulls.filter(cascade.contains("key")).count() == 0


PAGES = [
    (1, "http://a.net/x"), (2, "https://net/"), (3, "http://a.net"), (4, "HTTP://A.Example.NET/en/1?q"),
    (5, "http://example.net/en"), (6, "http://example.com/de/#x"), (7, "http://notexample.com/de/"),
    (8, "http://w.org/fr/a"), (9, "http://w.org/fra"), (10, None), (11, "no scheme"), (12, "x://y://net/"),
    (13, ""), (14, "http://evilnet/"), (15, "http://É.net/en/"), (16, "http://a\n.net/b"), (None, "http://b.net/"),
    (1, "http://a.net/x"), (17, "http://" + "a." * 3000 + "net/" + "x" * 50_000), (18, "http://x.net?/en/"),
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in PAGES], "page_id long, url string, host string")
    got = urls.judge(pages, urls.UrlRules.of(urls.rules_frame(spark, RULES)))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = sorted(repr((i, u, *judged(u))) for i, u in PAGES)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_urls_without_rules_or_pages(spark):
    rules = urls.UrlRules.of(urls.rules_frame(spark, RULES).limit(0))
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r)[2:] for r in urls.judge(pages, rules).collect()] == [("a.net", "/", None, "allow")]
    full = urls.UrlRules.of(urls.rules_frame(spark, RULES))
    assert urls.judge(pages.limit(0), full).count() == 0


CHATS = [
    (1, 1, "assistant", "second"), (1, 0, "user", "first <|im_end|>"), (2, 0, "user", None), (2, 1, None, "x\ny"),
    (3, 0, "sys\ntem", "<\\|im_start|> \\ <|"), (3, None, "user", ""), (None, 0, "user", "lone"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "assistant", "<" * 3 + "\\\\|" + "long " * 50_000),
    (5, 0, "assistant", "first"), (6, 0, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "é<|nl|>"),
]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame([(*c, "x") for c in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(rows)
    read = made.select("conv_id", "valid", "first_bad_turn", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("t"))
    got = {r["conv_id"]: r for r in read.collect()}
    want: dict = {}
    low = lambda v: (v is not None, v)
    for c, _, role, text in sorted(CHATS, key=lambda c: tuple(map(low, c[1:]))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["t"]] for c, r in got.items()} == want
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in got.values())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: False, 5: False, 6: True}
    assert {c: r["first_bad_turn"] for c, r in got.items()} == {1: None, 2: 1, 3: 1, None: None, 4: 1, 5: 0, 6: None}
    for r in chat.digests(made).collect():
        turns = want[r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        learned = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_chats(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(rows)).count() == 0


def test_native_plans_run_no_python(spark):
    sf = "/root/testdata/sf0.001"
    from riskflow.llm.queries import QUERIES

    for name in ("op2_mixing", "op7_url_filters", "op9_decontamination", "op10_chat_formatting"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan), name
