"""The numbered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import os
import random

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskflow.llm import common
from riskflow.llm.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert oracle.check(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) == []


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()
    assert set(QUERIES) - set(ORACLES) == {
        "op1_nearest_neighbours", "op3_toxicity", "op4_quality_classifier", "op5_token_counts", "op6_simhash_near_dedup", "op8_language_id"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with hard rows in a folder of their own."""
    root = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").first()["text"]
    hard = [(5000, None, None, None, None), (None, "no id but words", "en", "src1", 3), (5001, "", "en", None, 0),
            (5002, "intro " + item + " end", "en", "src2", 1), (5002, "intro " + item + " end", "en", "src2", 1)]
    extra = spark.createDataFrame(hard, docs.schema)
    docs.unionByName(extra).unionByName(docs.limit(20)).write.parquet(f"{root}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    return root


def test_pipeline_stages_decide(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "toxicity", "simhash near-dedup", "benchmark decontamination", "source mixing"]
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.stored(stage(spark, docs, tables))
        if i < 4:
            assert docs.columns == COLUMNS
            sizes.append(docs.count())
            assert docs.join(before, COLUMNS, "left_anti").filter("doc_id is not null and text is not null and source is not null").count() == 0
        if i == 0:
            bad = docs.join(labels, "doc_id").groupBy("quality").count().collect()
            assert {r["quality"]: r["count"] for r in bad}[1] >= 0.99 * labels.filter("quality = 1").count()
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 5
    assert docs.filter("doc_id = 5002").count() == 0
    assert docs.columns == [*COLUMNS, "size", "source_size", "target", "epoch"]
    by_source = docs.groupBy("source").agg(F.sum("size").alias("n"), F.first("target").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r["n"] - r["t"]) <= 2 * r["m"] for r in by_source)
    assert docs.agg(F.max("epoch")).first()[0] <= 2


def test_pipeline_of_nothing(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, tables))
    assert docs.count() == 0


def test_near_dedup_stage_drops_every_near_copy(spark):
    """Near copies of five-word Jaccard 0.8 or more, most beyond three bits, and pairs just below; against all pairs."""
    source = random.Random(7)
    texts = []
    for size in (12, 40, 120, 600):
        for _ in range(6):
            base = [f"w{source.randrange(5000)}" for _ in range(size)]
            for edits in (0, 1, 1, 2, max(size // 60, 1), size // 40, size // 25):
                copy = base.copy()
                for at in source.sample(range(size), edits):
                    copy[at] = f"e{source.randrange(5000)}"
                texts.append(" ".join(copy))
    line = " ".join(f"common{i}" for i in range(30))
    texts += [f"{line} own{i} own{i + 1}" for i in range(40)] + [f"{line} " + " ".join(f"x{i}-{j}" for j in range(60)) for i in range(20)]
    texts += ["", None, " ", "few words here", "Few  WORDS here", "few words there"]
    source.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    kept = corpus_pipeline.near_dedup_stage(spark, docs.unionByName(docs.limit(9)), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_stages_pass_clashing_columns_and_long_texts(spark, tables):
    """Columns named like anything inside change no decision and arrive as they were."""
    names = ["_score", "_toxicity", "items", "N_Hit", "contaminated", "n_words", "_own", "_doc", "_hash", "_n", "k1", "root", "w1",
             "epochs", "threshold", "_key", "_mix_source", "_mix_hash", "label", "score"]
    long = [(7001, "word " * 200_000, "en", "src1", 1), (7002, "x" * 1_000_000, "en", "src1", 1)]
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(300)
    docs = common.stored(docs.unionByName(spark.createDataFrame(long, docs.schema)))
    for _, stage in corpus_pipeline.STAGES:
        wide = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in names])
        plain, got = common.stored(stage(spark, docs, tables)), common.stored(stage(spark, wide, tables))
        assert got.drop(*names).columns == plain.columns and set(names) <= set(got.columns)
        assert got.select(*plain.columns).exceptAll(plain).count() == plain.exceptAll(got.select(*plain.columns)).count() == 0
        assert got.select(names).distinct().collect() == [tuple(f"mine {c}" for c in names)]
        docs = plain.select(*COLUMNS)


def test_run_is_the_chain_of_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "epoch" in got.columns
