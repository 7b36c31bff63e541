"""Named queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, collocations, decontaminate, extract, language, lattice, minhash, negatives, pieces, quality, sharding, tokencount, urlfilter
from quire.llm.tables import table


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").alias("n_near_items"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lattice_dedup, op2_sentencepiece, op3_decontamination, op4_chat_formatting, op5_quality_classifier, op6_token_counts, op7_sharding, op8_language_id, op9_minhash_dedup, op10_html_extraction, op11_url_filter, op12_collocations, op13_hard_negatives)}

ORACLE: dict[str, str] = {
    "op4_chat_formatting": """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) pos FROM conversations),
r AS (SELECT conv_id, pos, coalesce(role, 'unknown') AS shown, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
             to_json([role, text]) AS exact FROM t),
p AS (SELECT conv_id, pos, string_agg(exact, '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
c AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM p WHERE pos = n GROUP BY prefix),
k AS (SELECT * FROM c WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT k.conv_id, k.n_turns, k.n_copies, string_agg(r.said, '' ORDER BY r.pos) AS rendered
FROM k JOIN r ON k.conv_id = r.conv_id GROUP BY k.conv_id, k.n_turns, k.n_copies""",
    # Absolute targets in plain quoting; tests/llm covers all other spellings.
    "op11_url_filter": """
WITH RECURSIVE r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
l AS (SELECT url AS source, unnest(regexp_extract_all(html, '(?is)<link[^>]*rel=["'']?canonical["'']?[^>]*>')) AS tag FROM pages
      UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta[^>]*http-equiv=["'']?refresh["'']?[^>]*>')) FROM pages),
e AS (SELECT DISTINCT split_part(source, '#', 1) AS x, split_part(regexp_extract(tag, '(?i)https?://[^"''>\\s]+'), '#', 1) AS y FROM l WHERE source LIKE '%://%' AND tag LIKE '%://%'),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
c AS (SELECT x AS node, x AS alias FROM b UNION SELECT c.node, b.y FROM c JOIN b ON c.alias = b.x),
u AS (SELECT alias AS url FROM c UNION SELECT url FROM pages),
h AS (SELECT url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT h.url, h.host, h.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY h.url, h.host, h.path),
d AS (SELECT c.node, bool_or(j.verdict = 'block') AND NOT coalesce(bool_or(j.verdict = 'allow'), false) AS blocked FROM c JOIN j ON c.alias = j.url GROUP BY c.node)
SELECT p.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN d.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN j ON p.url IS NOT DISTINCT FROM j.url LEFT JOIN d ON split_part(p.url, '#', 1) = d.node""",
    "op12_collocations": """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k AS size, unnest(list_transform(range(1, greatest(1, len(words) - k + 2)), lambda i: words[i:i + k - 1])) AS g FROM w, range(1, 4) r(k)),
c AS (SELECT lang, size, g, count(*) AS f FROM g GROUP BY lang, size, g),
h AS (SELECT lang, g, f, k, g[:k] AS head, g[k + 1:] AS tail FROM c, range(1, 3) n(k) WHERE size > k AND f >= 10),
cut AS (SELECT h.lang, h.g, h.f AS a, x.f AS l, y.f AS r, k, ((1000000::HUGEINT * h.f * h.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM h JOIN c x ON x.lang = h.lang AND x.g = h.head JOIN c y ON y.lang = h.lang AND y.g = h.tail),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, a, g[1:2] AS g FROM s WHERE len(g) = 3 UNION ALL SELECT lang, a, g[2:3] FROM s WHERE len(g) = 3) GROUP BY lang, g),
kept AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, s.l, s.r, s.score FROM s LEFT JOIN longer o ON o.lang = s.lang AND o.g = s.g WHERE coalesce(100 * o.a < 50 * s.a, true))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN t ON t.lang = k.lang QUALIFY rank <= 2000""",
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS n, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS anchor, a.id AS anchor_id, b.n, b.id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.n <> b.n),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
h AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3""",
}
