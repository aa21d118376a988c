"""Token counts against the tokenizer itself, languages on pages with misleading evidence."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from riskflow.llm import language, tokens

VOCABULARY = tokens.read_vocabulary(tokens.VOCABULARY)
TINY = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("▁a", -5.0), ("abab", -7.5)]


def library(vocabulary):
    least = min(s for _, s in vocabulary)
    made = Tokenizer(models.Unigram([("<unk>", least), *vocabulary], 0, False))
    made.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("vocabulary", [TINY, VOCABULARY], ids=["ties", "public"])
def test_counts_equal_the_tokenizer(vocabulary):
    count, want, source = tokens.Counter(vocabulary), library(vocabulary), random.Random(3)
    texts = ["", " ", "  a  b ", "▁▁a", "日本\n語", "\x00\x01 é̱", "𐍈𐍈 𐍈", "ab" * 3000]
    texts += ["".join(source.choices("abab ▁cé\n日", k=source.randint(1, 40))) for _ in range(2000)]
    assert [t for t in texts if count.count_text(t) != want(t)] == []


def test_unknown_characters_fall_back_to_bytes(spark):
    least = min(s for _, s in VOCABULARY)
    more = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    made = Tokenizer(models.Unigram([("<unk>", least), *VOCABULARY, *more], 0, True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    assert tokens.byte_fallback(tokens.VOCABULARY)
    source = random.Random(5)
    texts = ["", "a\n\nb", "𐍈", "𐍈𐍈 𐍈\x01", "日本\n語"]
    texts += ["".join(source.choices("abab ▁cé\n日𐍈\x02", k=source.randint(1, 40))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs).collect()}
    assert got == {i: len(made.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("vocabulary", [TINY, VOCABULARY], ids=["ties", "public"])
def test_long_words_and_stretches_equal_the_tokenizer(vocabulary, monkeypatch):
    want, source = library(vocabulary), random.Random(7)
    texts = ["".join(source.choices("abcé日", k=30_000)), "".join(source.choices("abab ", k=30_000)), "▁" * 9_000]
    wanted = list(map(want, texts))
    for held, stretch in [(4_096, 1_000_000), (1, 10), (3, 1_000)]:
        monkeypatch.setattr(tokens, "HELD", held)
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        count = tokens.Counter(vocabulary)
        assert list(map(count.count_text, texts)) == wanted
        assert all(len(word) <= tokens.REMEMBERED for word in count)


def test_a_text_without_blanks_takes_bounded_memory():
    def peak(text):
        tracemalloc.start()
        count.count_text(text)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    count, text = tokens.Counter(VOCABULARY), "".join(random.Random(9).choices("abcdefgh", k=1_000_000))
    # The copies of the text itself, not a multiple of hundreds of bytes a character.
    assert peak(text) < 12 * len(text)


def test_counts_of_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x"), (4, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_tokens string")
    want = library(VOCABULARY)
    got = tokens.count_tokens(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_tokens"])) for r in got) == sorted(repr((i, want(t or ""))) for i, t in rows)
    assert tokens.count_tokens(docs.limit(0)).count() == 0
    assert tokens.Counter([]).count_text("a b") == 2


EN, FR = "the quick brown fox and the lazy dog with their things", "le renard brun et les chiens avec une chose dans la maison"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("en", f"{EN} {i}") for i in range(40)] + [("fr", f"{FR} {i}") for i in range(40)] + [(None, EN), ("en", None)]
    return spark.createDataFrame(rows, "lang string, text string")


def page(lang, body):
    return f"<!DOCTYPE html><HTML data-x=1 LANG='{lang}-XX'><script>the the the</script><body>{body}</body></html>"


def test_languages_of_hard_pages(spark, documents):
    rows = [(i, f"http://h{i % 3}.site.fr/", page("fr", FR)) for i in range(60)]
    rows += [(100 + i, f"http://h{i % 3}.site.com/", page("en", EN)) for i in range(60)]
    # A declaration against a long text; no text, then only host and declaration; no evidence but the rest.
    rows += [(200, "http://h1.site.com/", page("en", FR + " " + FR)), (201, "http://h1.site.fr/", page("fr", "")),
             (202, "http://h1.site.fr/", None), (203, None, None), (204, "", "<p>" + EN), (204, "", "<p>" + EN),
             (None, "http://new.host.com/", page("xx", (EN + " ") * 20_000))]
    pages = spark.createDataFrame([(*r, "l") for r in rows], "page_id long, url string, html string, lang string")
    got = language.identify(pages, documents).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["lang"] == "fr" for i in range(60)) and all(by[100 + i]["lang"] == "en" for i in range(60))
    assert [by[i]["lang"] for i in (200, 201, 202, 204, None)] == ["fr", "fr", "fr", "en", "en"]
    assert by[201]["text_lang"] is None and by[203]["lang"] in ("en", "fr") and by[None]["declared"] is None
    assert all(0.5 <= r["posterior"] <= 1 for r in got)
    assert language.identify(pages.limit(0), documents).count() == 0
    blind = language.identify(pages, documents.limit(0)).collect()
    assert len(blind) == len(rows) and {r["lang"] for r in blind} == {None}


def test_a_rare_language_is_answered(spark):
    """One text among 12,000, with a hash beyond the sample's, is learned like any other."""
    rare = "der schnelle braune fuchs springt über den faulen hund und seine dinge"
    rows = [("en", f"{EN} {i}") for i in range(6000)] + [("fr", f"{FR} {i}") for i in range(6000)]
    drawn = spark.createDataFrame([(f"{rare} {i}",) for i in range(50)], "text string")
    last = drawn.orderBy(F.xxhash64(F.lit(8), "text").desc()).first()["text"]
    docs = spark.createDataFrame([*rows, ("de", last), ("xx", "12 34")], "lang string, text string")
    assert language.fit_text(docs)[0] == ["de", "en", "fr"]
    assert language.fit_text(docs, rows=1)[0] == ["de", "en", "fr"]
    pages = [(i, f"http://a{i}.site.de/", page("de", rare)) for i in range(5)] + [(9, "http://b.site.com/", page("en", EN))]
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()
    assert {r["page_id"]: (r["declared"], r["lang"]) for r in got} == {i: ("de", "de") for i in range(5)} | {9: ("en", "en")}


def test_languages_of_the_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents"))
    found = language.identify(pages, docs).join(pages.select("page_id", "url"), "page_id")
    path = F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1)
    assert found.agg(F.avg((F.col("lang") == path).cast("int"))).first()[0] >= 0.98
