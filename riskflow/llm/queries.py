"""The numbered queries over whole tables, each with the SQL that states its rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import ann, chat, decontaminate, language, mixing, negatives, phrases, quality, rules, simhash, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op2_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source,
             COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('0:' || COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
      FROM documents),
    s AS (
      SELECT source, SUM(size)::BIGINT AS s, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
      FROM d GROUP BY source),
    f AS (
      SELECT *, (SUM(s) OVER ())::BIGINT AS a,
             COALESCE(SUM(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2 AS c,
             (SUM(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS q
      FROM s WINDOW o AS (ORDER BY s::DOUBLE / w, source NULLS LAST)),
    t AS (
      SELECT source, s, LEAST(s * 2.0::DOUBLE, (MAX((a * 3 - c * 2) / (q * 2)::DOUBLE) OVER ()) * w) AS target FROM f),
    e AS (
      SELECT *, floor(target / GREATEST(s, 1))::BIGINT AS e,
             target - floor(target / GREATEST(s, 1))::BIGINT * s AS rest FROM t),
    c AS (
      SELECT d.doc_id, d.size, e.s, e.target, e.e, e.rest,
             (SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING))::BIGINT AS upto,
             (SUM(d.size) OVER (PARTITION BY d.source, d.h))::BIGINT AS tied
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
    b AS (
      SELECT *, CASE WHEN upto <= rest THEN 1 WHEN upto - tied <= rest AND upto - rest < rest - (upto - tied) THEN 1 ELSE 0 END AS x
      FROM c)
    SELECT doc_id, size, s AS source_size, target,
           CASE WHEN s > 0 THEN (e + x) * size ELSE 0 END::BIGINT AS taken
    FROM b
    """,
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The rules of the contract: fixed values.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@_query(
    "op7_url_filters",
    r"""
    WITH p AS (
      SELECT page_id,
             translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages),
    r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    m AS (
      SELECT p.*, (SELECT arg_max({'rule': r.h || r.p, 'v': r.v}, length(r.h) + length(r.p)) FROM r
                   WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS best
      FROM p)
    SELECT page_id, host, path, best.rule AS rule, COALESCE(best.v, 'allow') AS verdict FROM m
    """,
)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.UrlRules.of(urls.rules_frame(spark, URL_RULES))
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@_query(
    "op9_decontamination",
    r"""
    WITH dw AS (
      SELECT doc_id, md5(COALESCE(text, '')) AS t, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (
      SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    wins AS (
      SELECT DISTINCT item, LEAST(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, GREATEST(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM wins),
    spots AS (
      SELECT doc_id, t, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
      FROM (SELECT DISTINCT doc_id, t, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, t, spots.s, spots.n, item FROM spots JOIN wins USING (n, win)),
    hit_words AS (SELECT doc_id, t, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, t, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id, t),
    hit_items AS (SELECT doc_id, t, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id, t)
    SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit,
           COALESCE(len(items), 0)::BIGINT AS n_items,
           sha256(COALESCE(array_to_string(items, ','), '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hit_words USING (doc_id, t) LEFT JOIN hit_items USING (doc_id, t)
    """,
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@_query(
    "op10_chat_formatting",
    r"""
    WITH c AS (
      SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text, role AS r, text AS x FROM conversations
      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', 'assistant', '<|im_end|><|im_start|>assistant ok'),
    e AS (
      SELECT *, row_number() OVER (o) - 1 AS i,
             regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et,
             replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') AS er,
             CASE WHEN (COALESCE(lag(role) OVER (o), 'start') || '>' || role) IN (
               'start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool',
               'tool>assistant', 'tool>tool') THEN 0 ELSE 1 END AS bad
      FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)),
    g AS (
      SELECT conv_id, COUNT(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS whole,
             COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS learned,
             SUM(length(er) + length(et) + 24)::BIGINT AS formatted_chars,
             MIN(CASE WHEN bad = 1 THEN i END) AS first_bad_turn, arg_max(role, i) AS final
      FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
           formatted_chars, first_bad_turn IS NULL AND final = 'assistant' AS valid, first_bad_turn
    FROM g
    """,
)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    rows = rows.unionByName(extra)
    return chat.digests(chat.format_chats(rows))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels")).drop("text")


@_query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).drop("text")


@_query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@_query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@_query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents").select("lang", "text"))


@_query(
    "op12_quality_rules",
    r"""
    WITH d AS (SELECT doc_id, lang, COALESCE(text, '') AS text, row_number() OVER () AS r FROM documents),
    w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, text FROM d),
    spots AS (SELECT r, s, array_to_string(w[s:s + 2], ' ') AS win
              FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) >= 3)),
    twice AS (SELECT r, win FROM spots GROUP BY r, win HAVING COUNT(*) > 1),
    rep AS (SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 3)) AS p FROM spots JOIN twice USING (r, win)) GROUP BY r),
    m AS (
      SELECT d.doc_id, d.lang, d.r, len(w.w)::BIGINT AS n_words, COALESCE(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, COALESCE(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
    b AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             LEAST(COALESCE(word_chars * 100 // NULLIF(n_words, 0), 0), 10000) AS len100,
             [COALESCE(n_symbols * 10000 // NULLIF(word_chars, 0), 0), COALESCE(n_dup_lines * 10000 // NULLIF(n_lines, 0), 0),
              COALESCE(n_repeat_words * 10000 // NULLIF(n_words, 0), 0), len100, 10000 - len100] AS v FROM m),
    l AS (SELECT doc_id, MAX(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    k AS (SELECT b.*, label, ('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INT % 2 = 1 AS holdout FROM b JOIN l USING (doc_id) WHERE NOT base_failed),
    rungs(j, share) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 5), (5, 8), (6, 12), (7, 20)),
    h AS (
      SELECT lang, i, v[i] AS x, COUNT(*) FILTER (label = 1) AS g, COUNT(*) FILTER (label = 0) AS bad
      FROM k, range(1, 6) AS q(i) WHERE NOT holdout GROUP BY ALL),
    c AS (
      SELECT *, COALESCE(SUM(g) OVER o, 0) AS ga, COALESCE(SUM(bad) OVER o, 0) AS ba, SUM(g) OVER p AS ng, SUM(bad) OVER p AS nb
      FROM h WINDOW o AS (PARTITION BY lang, i ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY lang, i)),
    cut AS (
      SELECT lang, i, j, MIN(x) AS x, arg_min(ga, x) AS lost, arg_min(ba, x) AS caught, MAX(ng) AS ng, MAX(nb) AS nb
      FROM c, rungs WHERE g > 0 AND ga * 1000 <= ng * share GROUP BY lang, i, j),
    used AS (SELECT cut.* FROM cut JOIN (SELECT lang AS ul, i AS ui FROM cut WHERE j = 7 AND caught * ng > lost * nb)
             ON ul IS NOT DISTINCT FROM lang AND ui = i),
    hit AS (SELECT b.r, MIN(j) AS j FROM b JOIN used ON used.lang IS NOT DISTINCT FROM b.lang AND b.v[used.i] > used.x GROUP BY b.r),
    t AS (SELECT k.lang, hit.j FROM k LEFT JOIN hit USING (r) WHERE holdout AND label = 1),
    n AS (SELECT lang, COUNT(*) AS n FROM t GROUP BY lang),
    lost AS (SELECT n.lang, n.n, rungs.j, (SELECT COUNT(*) FROM t WHERE t.lang IS NOT DISTINCT FROM n.lang AND t.j <= rungs.j) AS lost FROM n, rungs),
    cdf AS (
      SELECT lang, i, SUM(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98))) OVER (PARTITION BY lang ORDER BY i) AS p
      FROM (SELECT lang, n, unnest(range(0, ceil(n * 0.02)::BIGINT + 1)) AS i FROM n)),
    crit AS (SELECT lang, MAX(i) AS most FROM cdf WHERE p <= 0.05 / (SELECT COUNT(*) FROM n) GROUP BY lang),
    caught AS (SELECT k.lang, rungs.j, COUNT(*) AS n FROM k JOIN hit USING (r) JOIN rungs ON hit.j <= rungs.j WHERE NOT holdout AND label = 0 GROUP BY ALL),
    best AS (
      SELECT lost.lang, arg_min(lost.j, COALESCE(caught.n, 0) * -100 + lost.j) AS j
      FROM lost JOIN crit ON crit.lang IS NOT DISTINCT FROM lost.lang AND lost.lost <= most
      LEFT JOIN caught ON caught.lang IS NOT DISTINCT FROM lost.lang AND caught.j = lost.j GROUP BY lost.lang)
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND COALESCE(hit.j > best.j, TRUE) AS kept
    FROM b LEFT JOIN hit USING (r) LEFT JOIN best ON best.lang IS NOT DISTINCT FROM b.lang
    """,
)
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rules.judge(docs, _table(spark, sf_dir, "labels")).drop("stratum", "n_lines")


@_query(
    "op13_hard_negatives",
    r"""
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
    n AS (
      SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INT AS rank
      FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
    SELECT * FROM n WHERE rank <= 5
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


@_query(
    "op11_collocations",
    r"""
    WITH t AS (
      SELECT COALESCE(lang, 'und') AS lang, row_number() OVER () AS r,
             translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
          FROM (SELECT lang, r, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
    g AS (
      SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM p, range(1, 5) AS q(m) WHERE len(w) >= m)),
    f AS (SELECT lang, m, phrase, COUNT(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
    inner_ AS (
      SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, MAX(a) AS longer
      FROM (SELECT lang, w, a, m, k, unnest(range(1, m - k + 2)) AS s FROM c, range(2, 4) AS q(k) WHERE k < m) GROUP BY ALL),
    kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
    cuts AS (
      SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS last
      FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
    s AS (
      SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = last),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM b JOIN n USING (lang) QUALIFY rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))
