"""Named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is
SQL over the same parquet tables (registered as views by the driver) that
must give the same rows.  Column names match between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.requests import key_table, languages_table
from quire.operators import lookup
from quire.plans import fixtures as fx
from quire.plans.fixtures import FIXTURE_SQL
from quire.plans.search_oracle import SEARCH_SQL, VARIANTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _as_longs(df: DataFrame) -> DataFrame:
    """Integral columns leave as BIGINT so both engines agree on types."""
    small = ("int", "smallint", "tinyint")
    return df.select(*[F.col(n).cast("bigint").alias(n) if t in small else F.col(n) for n, t in df.dtypes])


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register ``fn`` under ``name`` with its oracle; ``ints`` lists the
    oracle's integer columns, cast to BIGINT like the Spark side."""
    def wrap(fn):
        def run(spark, sf_dir):
            return _as_longs(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = FIXTURE_SQL + sql
            if ints:
                casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ints)
                body = f"SELECT * REPLACE ({casts}) FROM ({body}) AS q"
            ORACLE[name] = body
        return fn
    return wrap


# Fixed language list used by the fixture queries, in priority order.
LANGS_SQL = "['en', 'fr', 'de', 'es']"


def _requests_k(spark, sf_dir, all_langs: bool = False):
    """K from the fixture requests with the first two variant rules
    (stripped title, capitalised form) -- the part of V1 that plain SQL
    states compactly."""
    docs = fx.fx_documents(spark, sf_dir)
    req = fx.fx_requests(docs)
    s = T.py_strip("title")
    cap = T.capitalize(s)
    variants = F.array_distinct(F.when((cap != F.col("title")), F.array(s, cap)).otherwise(F.array(s)))
    langs = languages_table(fx.LANGUAGES) if all_langs else F.array("language_code")
    v = req.select("request_id", variants.alias("variants"), langs.alias("search_langs"))
    return docs, key_table(v)


_K_SQL = r"""
, fx_v AS (
  SELECT request_id, title AS raw, regexp_replace(title, '^\s+|\s+$', '', 'g') AS s, language_code FROM fx_requests
), fx_v2 AS (
  SELECT request_id, raw, s, upper(substring(s, 1, 1)) || lower(substring(s, 2)) AS cap, language_code FROM fx_v
), fx_vars AS (
  SELECT request_id, 0 AS variant_rank, s AS variant, language_code FROM fx_v2
  UNION ALL
  SELECT request_id, 1, cap, language_code FROM fx_v2 WHERE cap <> raw AND cap <> s
)
"""

_K_ALL_LANGS_SQL = _K_SQL + f"""
, fx_k0 AS (SELECT request_id, variant_rank, variant, unnest(range(4)) AS lang_rank FROM fx_vars)
, fx_k AS (SELECT request_id, variant_rank, variant, lang_rank,
                  list_extract({LANGS_SQL}, lang_rank + 1) AS language_code FROM fx_k0)
"""

_PAGE_KEY_SQL = "upper(substring(replace({c}, ' ', '_'), 1, 1)) || substring(replace({c}, ' ', '_'), 2)"


# --- E1-E4 -------------------------------------------------------------------

@query("page_key_normalise", r"""
SELECT request_id, title,
       """ + _PAGE_KEY_SQL.format(c="title") + r""" AS page_key,
       replace(title, '_', ' ') AS document_key
FROM fx_requests
""")
def page_key_normalise(spark, sf_dir):
    req = fx.fx_requests(fx.fx_documents(spark, sf_dir))
    return req.select("request_id", "title", T.page_key("title").alias("page_key"),
                      T.document_key("title").alias("document_key"))


@query("text_units", r"""
SELECT page_id, language_code,
       language_code IN ('ja', 'zh', 'ko') AS is_cjk,
       CASE WHEN language_code IN ('ja', 'zh', 'ko') THEN length(text_body)
            ELSE len(list_filter(regexp_split_to_array(text_body, '\s+'), lambda x: x <> '')) END AS units,
       length(text_body) AS n_chars
FROM fx_documents
""")
def text_units(spark, sf_dir):
    d = fx.fx_documents(spark, sf_dir)
    cjk = T.is_cjk("language_code")
    return d.select("page_id", "language_code", cjk.alias("is_cjk"),
                    T.text_units("text_body", cjk).alias("units"),
                    F.length("text_body").alias("n_chars"))


# --- J1-J4, W2 ---------------------------------------------------------------

@query("exact_title_lookup", r"""
SELECT r.request_id, r.language_code, min(d.page_id) AS page_id
FROM fx_requests r JOIN fx_documents d
  ON d.title = replace(r.title, '_', ' ') AND d.language_code = r.language_code
GROUP BY r.request_id, r.language_code
""")
def exact_title_lookup(spark, sf_dir):
    docs = fx.fx_documents(spark, sf_dir)
    req = fx.fx_requests(docs).select("request_id", "language_code", F.col("title").alias("variant"))
    return lookup.exact_titles(req, docs).select("request_id", "language_code", "page_id")


@query("exact_redirect_resolution", r"""
, fx_p AS (
  SELECT r.request_id, r.language_code, min(p.page_id) AS redirect_page_id
  FROM fx_requests r JOIN fx_pages p
    ON p.page_title = """ + _PAGE_KEY_SQL.format(c="r.title") + r""" AND p.language_code = r.language_code
  GROUP BY r.request_id, r.language_code HAVING min(p.page_id) <> 0
), fx_t AS (
  SELECT p.request_id, p.language_code, p.redirect_page_id, min(x.to_title) AS to_title
  FROM fx_p p JOIN fx_redirections x ON x.from_page_id = p.redirect_page_id AND x.language_code = p.language_code
  GROUP BY p.request_id, p.language_code, p.redirect_page_id HAVING min(x.to_title) <> ''
)
SELECT t.request_id, t.language_code, t.redirect_page_id, t.to_title, min(d.page_id) AS page_id
FROM fx_t t JOIN fx_documents d ON d.title = replace(t.to_title, '_', ' ') AND d.language_code = t.language_code
GROUP BY t.request_id, t.language_code, t.redirect_page_id, t.to_title
""")
def exact_redirect_resolution(spark, sf_dir):
    docs = fx.fx_documents(spark, sf_dir)
    req = fx.fx_requests(docs).select("request_id", "language_code", F.col("title").alias("variant"))
    out = lookup.exact_redirects(req, docs, fx.fx_pages(docs), fx.fx_redirections(docs))
    return out.select("request_id", "language_code", "redirect_page_id", "to_title", "page_id")


@query("raw_title_lookup", r"""
, fx_rk AS (
  SELECT request_id, language_code, 0 AS spelling, title AS variant FROM fx_requests
  UNION ALL SELECT request_id, language_code, 1, replace(title, ' ', '_') FROM fx_requests
)
SELECT r.request_id, r.spelling, min(d.page_id) AS page_id
FROM fx_rk r JOIN fx_documents d ON d.title = r.variant AND d.language_code = r.language_code
GROUP BY r.request_id, r.spelling
""", ints=("spelling",))
def raw_title_lookup_q(spark, sf_dir):
    """Titles looked up as they are spelt; underscores are no spaces here."""
    docs = fx.fx_documents(spark, sf_dir)
    spellings = F.posexplode(F.array("title", F.replace("title", F.lit(" "), F.lit("_")))).alias("spelling", "variant")
    req = fx.fx_requests(docs).select("request_id", "language_code", spellings)
    return lookup.exact_titles(req, docs, raw_key=True).select("request_id", "spelling", "page_id")


def _bucketed(spark, sf_dir):
    """Fixture titles as key rows, and the fixture corpus stored in buckets."""
    from quire.plans import buckets
    from quire.session import shared_dir
    c = buckets.store_corpus(fx.corpus(spark, sf_dir, with_indexes=False), shared_dir(spark, "bucketed"))
    req = fx.fx_requests(c.documents).select("request_id", "language_code", F.col("title").alias("variant"))
    return c, req


@query("bucketed_title_lookup")
def bucketed_title_lookup_q(spark, sf_dir):
    """J1 over documents stored in buckets of (language, title)."""
    c, req = _bucketed(spark, sf_dir)
    return lookup.exact_titles(req, c.documents).select("request_id", "language_code", "page_id")


@query("bucketed_redirect_resolution")
def bucketed_redirect_resolution_q(spark, sf_dir):
    """J2-J4 over pages, redirects and documents in buckets of their keys."""
    c, req = _bucketed(spark, sf_dir)
    out = lookup.exact_redirects(req, c.documents, c.pages, c.redirections)
    return out.select("request_id", "language_code", "redirect_page_id", "to_title", "page_id")


ORACLE["bucketed_title_lookup"] = ORACLE["exact_title_lookup"]
ORACLE["bucketed_redirect_resolution"] = ORACLE["exact_redirect_resolution"]


@query("first_match_cascade", _K_ALL_LANGS_SQL + r"""
, fx_s1 AS (
  SELECT k.request_id, k.variant_rank, k.lang_rank, k.variant, k.language_code, 1 AS stage,
         min(d.page_id) AS page_id, CAST(NULL AS VARCHAR) AS to_title
  FROM fx_k k JOIN fx_documents d ON d.title = replace(k.variant, '_', ' ') AND d.language_code = k.language_code
  GROUP BY ALL
), fx_p AS (
  SELECT k.request_id, k.variant_rank, k.lang_rank, k.variant, k.language_code, min(p.page_id) AS rp
  FROM fx_k k JOIN fx_pages p
    ON p.page_title = """ + _PAGE_KEY_SQL.format(c="k.variant") + r""" AND p.language_code = k.language_code
  GROUP BY ALL HAVING min(p.page_id) <> 0
), fx_t AS (
  SELECT p.request_id, p.variant_rank, p.lang_rank, p.variant, p.language_code, min(x.to_title) AS to_title
  FROM fx_p p JOIN fx_redirections x ON x.from_page_id = p.rp AND x.language_code = p.language_code
  GROUP BY ALL HAVING min(x.to_title) <> ''
), fx_s2 AS (
  SELECT t.request_id, t.variant_rank, t.lang_rank, t.variant, t.language_code, 2 AS stage,
         min(d.page_id) AS page_id, t.to_title
  FROM fx_t t JOIN fx_documents d ON d.title = replace(t.to_title, '_', ' ') AND d.language_code = t.language_code
  GROUP BY t.request_id, t.variant_rank, t.lang_rank, t.variant, t.language_code, t.to_title
), fx_all AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY variant_rank, lang_rank, stage) AS rn
  FROM (SELECT * FROM fx_s1 UNION ALL SELECT * FROM fx_s2)
)
SELECT request_id, variant_rank, lang_rank, variant, language_code, stage, page_id, to_title
FROM fx_all WHERE rn = 1
""", ints=("variant_rank", "lang_rank", "stage"))
def first_match_cascade(spark, sf_dir):
    from quire.session import materialize
    docs, k = _requests_k(spark, sf_dir, all_langs=True)
    k = materialize(k, "keys")  # read by every lookup
    out = lookup.first_exact_match(k, docs, fx.fx_pages(docs), fx.fx_redirections(docs))
    return out.select("request_id", "variant_rank", "lang_rank", "variant", "language_code", "stage",
                      "page_id", "to_title")


# --- X1-X6 on the conversation articles -----------------------------------------

def _anc_sql(lim: str) -> str:
    """Ancestors as text: of the last heading seen per level (lh1..lh6),
    levels up to ``lim`` whose heading is newer than every heading of a
    shallower level (an older one would have been closed by it)."""
    parts = []
    for k in range(1, 7):
        shallower = ", ".join(f"lh{j}" for j in range(1, k)) or "NULL"
        parts.append(f"CASE WHEN {k} <= {lim} AND lh{k} IS NOT NULL AND lh{k} > coalesce(greatest({shallower}, NULL), -1) "
                     f"THEN CAST(lh{k} AS VARCHAR) END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


_LH = ",\n         ".join(f"max(CASE WHEN h_level = {k} THEN heading_no END) OVER w AS lh{k}" for k in range(1, 7))

BLOCKS_SQL = r"""
, fx_lines AS (
  SELECT page_id, language_code, unnest(string_split(text_body, chr(10))) AS line,
         unnest(range(len(string_split(text_body, chr(10))))) AS line_no
  FROM fx_articles
), fx_cls AS (
  SELECT *, regexp_matches(line, '^#{1,6}\s+.+$') AS is_h FROM fx_lines
  WHERE regexp_matches(line, '^#{1,6}\s+.+$') OR regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''
), fx_b0 AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS block_no,
         CASE WHEN is_h THEN length(regexp_extract(line, '^(#{1,6})', 1)) END AS h_level,
         sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no
                                                     ROWS UNBOUNDED PRECEDING) AS heading_no
  FROM fx_cls
), fx_b1 AS (
  SELECT *, """ + _LH + r"""
  FROM fx_b0 WINDOW w AS (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), fx_heads AS (
  SELECT page_id, heading_no, h_level,
         h_level = 2 AND heading_no = min(CASE WHEN h_level = 2 THEN heading_no END) OVER (PARTITION BY page_id) AS special
  FROM fx_b1 WHERE is_h
), fx_blocks AS (
  SELECT b.language_code, b.page_id, b.block_no, b.line_no AS line_start,
         CASE WHEN b.is_h THEN 'heading' ELSE 'para' END AS kind,
         coalesce(h.h_level, 0) AS level,
         CASE WHEN b.is_h THEN regexp_replace(regexp_extract(b.line, '^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') END AS title,
         b.line AS content,
         coalesce(h.special, false) AS is_special,
         b.heading_no,
         CASE WHEN b.is_h THEN NULL
              ELSE row_number() OVER (PARTITION BY b.page_id, b.heading_no, b.is_h ORDER BY b.line_no) - 1 END AS idx_in_heading,
         CASE WHEN b.is_h THEN """ + _anc_sql("b.h_level - 1") + " ELSE " + _anc_sql("6") + r""" END AS ancestors_csv
  FROM fx_b1 b LEFT JOIN fx_heads h ON h.page_id = b.page_id AND h.heading_no = b.heading_no
)
"""

_BLOCK_INTS = ("page_id", "block_no", "line_start", "level", "heading_no", "idx_in_heading")


def _article_blocks_df(spark, sf_dir):
    from quire.operators import articles
    return articles.article_blocks(fx.fx_articles(spark, sf_dir))


def _with_csv(b):
    return b.withColumn("ancestors_csv", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ",")).drop("ancestors")


@query("article_blocks", BLOCKS_SQL + "SELECT * FROM fx_blocks", ints=_BLOCK_INTS)
def article_blocks_q(spark, sf_dir):
    return _with_csv(_article_blocks_df(spark, sf_dir))


PRIORITY_SQL = BLOCKS_SQL + r"""
, fx_prio AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY level, is_special DESC, idx_in_heading, heading_no) AS priority
  FROM fx_blocks WHERE kind = 'para'
)
"""


@query("block_priorities", PRIORITY_SQL + """
SELECT language_code, page_id, block_no, line_start, level, is_special, heading_no, idx_in_heading, priority
FROM fx_prio""", ints=_BLOCK_INTS + ("priority",))
def block_priorities_q(spark, sf_dir):
    from quire.operators import articles
    b = articles.block_priorities(_article_blocks_df(spark, sf_dir))
    return b.select("language_code", "page_id", "block_no", "line_start", "level", "is_special",
                    "heading_no", "idx_in_heading", "priority")


def _extract_sql(length: str, limit: int, tool: str) -> str:
    larger = "medium" if length == "short" else "full"
    words = "len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"
    return PRIORITY_SQL + rf"""
, fx_pu AS (
  SELECT *, {words.format(c='content')} AS units FROM fx_prio
), fx_hu AS (
  SELECT page_id, heading_no, level, title, line_start, content, {words.format(c='content')} AS h_units
  FROM fx_blocks WHERE kind = 'heading'
), fx_pairs AS (
  SELECT p.page_id, p.priority, CAST(unnest(string_split(p.ancestors_csv, ',')) AS BIGINT) AS h
  FROM fx_pu p WHERE p.ancestors_csv <> ''
), fx_first AS (
  SELECT page_id, h, min(priority) AS first_priority FROM fx_pairs GROUP BY page_id, h
), fx_charge AS (
  SELECT f.page_id, f.first_priority AS priority, sum(u.h_units) AS charge
  FROM fx_first f JOIN fx_hu u ON u.page_id = f.page_id AND u.heading_no = f.h
  GROUP BY f.page_id, f.first_priority
), fx_cost AS (
  SELECT p.*, p.units + coalesce(c.charge, 0) AS cost
  FROM fx_pu p LEFT JOIN fx_charge c ON c.page_id = p.page_id AND c.priority = p.priority
), fx_run AS (
  SELECT *, sum(cost) OVER (PARTITION BY page_id ORDER BY priority ROWS UNBOUNDED PRECEDING) AS running FROM fx_cost
), fx_kept AS (
  SELECT * FROM fx_run WHERE running <= {limit} OR priority = 1
), fx_last AS (
  SELECT page_id, max(priority) AS last_priority, count(*) AS n_kept FROM fx_kept GROUP BY page_id
), fx_npara AS (
  SELECT page_id, count(*) AS n_paras FROM fx_prio GROUP BY page_id
), fx_hreq AS (
  SELECT u.*, coalesce(f.first_priority <= l.last_priority, false) AS required
  FROM fx_hu u LEFT JOIN fx_first f ON f.page_id = u.page_id AND f.h = u.heading_no
  LEFT JOIN fx_last l ON l.page_id = u.page_id
), fx_parts AS (
  SELECT page_id, line_start, content FROM fx_kept
  UNION ALL SELECT page_id, line_start, content FROM fx_hreq WHERE required
), fx_body AS (
  SELECT page_id, string_agg(content, chr(10) || chr(10) ORDER BY line_start) AS body FROM fx_parts GROUP BY page_id
), fx_omit AS (
  SELECT page_id, string_agg(repeat('  ', CAST(level AS INT) - 2) || '- ' || title, chr(10) ORDER BY heading_no) AS omitted
  FROM fx_hreq WHERE NOT required AND level >= 2 GROUP BY page_id
), fx_out AS (
  SELECT a.page_id, a.language_code, coalesce(b.body, '') AS body, o.omitted,
         coalesce(l.n_kept, 0) < coalesce(n.n_paras, 0) AS cut_short
  FROM fx_articles a LEFT JOIN fx_body b ON b.page_id = a.page_id LEFT JOIN fx_omit o ON o.page_id = a.page_id
  LEFT JOIN fx_last l ON l.page_id = a.page_id LEFT JOIN fx_npara n ON n.page_id = a.page_id
)
"""


def _article_query(length: str):
    from quire.functions.fixed import DEFAULT_TOOL_NAME, LENGTH_LIMITS
    limit = LENGTH_LIMITS[length][0]
    sql = _extract_sql(length, limit, DEFAULT_TOOL_NAME)
    if length == "very-short":
        final = r"""SELECT page_id, language_code, '{L}' AS length,
  regexp_replace(body, '(?m)^#{{1,6}}(?:[^\S\n]+(\S.*?)[^\S\n]*|[^\S\n][^\S\n]+)$', '\1', 'g') AS article_text FROM fx_out""".format(L=length)
    else:
        larger = "medium" if length == "short" else "full"
        final = rf"""SELECT page_id, language_code, '{length}' AS length,
  body || CASE WHEN omitted IS NOT NULL THEN chr(10) || chr(10) || '## Omitted Headings' || chr(10) || omitted ELSE '' END
       || CASE WHEN cut_short THEN chr(10) || chr(10) || 'If you want to read more, please use the `{DEFAULT_TOOL_NAME}` tool with `length=''{larger}''` to get a more detailed article.' || chr(10) ELSE '' END
  AS article_text FROM fx_out"""

    def fn(spark, sf_dir):
        from quire.operators import articles
        a = fx.fx_articles(spark, sf_dir)
        targets = a.select("language_code", "page_id", F.lit(length).alias("length"))
        out = articles.extract(a, targets)
        return out.select("page_id", "language_code", "length", "article_text")
    fn.__name__ = "article_" + length.replace("-", "_")
    query("article_" + length.replace("-", "_"), sql + final, ints=("page_id",))(fn)


for _len in ("very-short", "short", "medium"):
    _article_query(_len)


@query("omitted_headings", _extract_sql("short", 150, "") + """
SELECT page_id, omitted FROM fx_omit""", ints=("page_id",))
def omitted_headings_q(spark, sf_dir):
    """X6 alone: the omitted-heading list of the short cut."""
    from quire.operators import articles
    a = fx.fx_articles(spark, sf_dir)
    out = articles.omitted_headings(articles.article_blocks(a),
                                    a.select("language_code", "page_id", F.lit("short").alias("length")))
    return out.select("page_id", "omitted")


# --- V1, E5-E6 -------------------------------------------------------------------

@query("query_variants", VARIANTS_SQL + "SELECT request_id, variant_rank, variant FROM fx_variants", ints=("variant_rank",))
def query_variants_q(spark, sf_dir):
    """V1 over every fixture request."""
    from quire.functions.variants import query_variants
    req = fx.fx_requests(fx.fx_documents(spark, sf_dir))
    v = req.select("request_id", query_variants("title", F.lit(False)).alias("v"))
    return v.select("request_id", F.posexplode("v").alias("variant_rank", "variant"))


_LANG_ARGS = ("language_code", "upper(language_code) || ',en'", "' ' || language_code || '  de '", "''",
              "language_code || ',xx'")


def _lang_args_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_LANG_ARGS[:-1]))
    return f"CASE k {cases} ELSE {_LANG_ARGS[-1]} END"


@query("language_arguments", r"""
, fx_la AS (
  SELECT page_id * 10 + k AS request_id, """ + _lang_args_sql() + r""" AS languages
  FROM (SELECT page_id, language_code, unnest([0, 1, 2, 3, 4]) AS k FROM fx_documents)
), fx_ln AS (
  SELECT request_id, languages, regexp_replace(languages, '^\s+|\s+$', '', 'g') AS s FROM fx_la
), fx_ln2 AS (
  SELECT request_id, languages,
         CASE WHEN s = '' THEN NULL
              WHEN contains(s, ',') THEN list_filter(list_transform(string_split(s, ','),
                     lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')
              WHEN contains(s, ' ') THEN list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')
              ELSE [s] END AS given
  FROM fx_ln
), fx_ln3 AS (
  SELECT request_id, languages,
         CASE WHEN given IS NULL OR len(given) = 0 THEN """ + LANGS_SQL + r"""
              ELSE list_transform(given, lambda x: lower(x)) END AS search
  FROM fx_ln2
), fx_ln4 AS (
  SELECT *, list_filter(search, lambda x: NOT list_contains(""" + LANGS_SQL + r""", x))[1] AS bad FROM fx_ln3
)
SELECT request_id, languages, array_to_string(search, ',') AS search_langs,
       CASE WHEN bad IS NOT NULL THEN 'Error: Language ''' || bad || ''' is not available. Available languages: [en, fr, de, es]' END AS error
FROM fx_ln4
""")
def language_arguments_q(spark, sf_dir):
    from quire.functions.languages import resolve_languages
    d = fx.fx_documents(spark, sf_dir)
    k = d.select("page_id", "language_code", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("k"))
    arg = F.expr(_lang_args_sql())
    req = k.select((F.col("page_id") * 10 + F.col("k")).alias("request_id"), arg.alias("languages"))
    out = resolve_languages(req, fx.LANGUAGES)
    return out.select("request_id", "languages", F.array_join("search_langs", ",").alias("search_langs"), "error")


# --- T1-T4, J5, C3-C5 ------------------------------------------------------------------

_TOK = r"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'))"


@query("postings_build", r"""
SELECT language_code, 'title' AS field, unnest(""" + _TOK.format(c="title") + r""") AS term, page_id FROM fx_documents
UNION ALL
SELECT language_code, 'body', unnest(""" + _TOK.format(c="text_body") + r"""), page_id FROM fx_documents
""")
def postings_build_q(spark, sf_dir):
    from quire.operators import textsearch
    d = fx.fx_documents(spark, sf_dir)
    return textsearch.build_postings(textsearch.document_terms(d))


@query("term_document_frequency", r"""
, fx_post AS (
  SELECT language_code, 'title' AS field, unnest(""" + _TOK.format(c="title") + r""") AS term, page_id FROM fx_documents
  UNION ALL
  SELECT language_code, 'body', unnest(""" + _TOK.format(c="text_body") + r"""), page_id FROM fx_documents
)
SELECT language_code, field, term, count(*) AS df FROM fx_post GROUP BY ALL
""")
def term_document_frequency_q(spark, sf_dir):
    from quire.operators import textsearch
    d = fx.fx_documents(spark, sf_dir)
    return textsearch.term_document_frequency(textsearch.build_postings(textsearch.document_terms(d)))


def _single_k(spark, sf_dir, indexes=("blocks",)):
    """Each fixture request as one key row: its title in its language."""
    c = fx.corpus(spark, sf_dir, with_indexes=False).materialize(indexes)
    req = fx.fx_requests(c.documents)
    k = req.select("request_id", F.lit(0).alias("variant_rank"), F.lit(0).alias("lang_rank"),
                   F.col("title").alias("variant"), "language_code")
    return c, k


def _top(df, order, n=20):
    w = Window.partitionBy("request_id").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


_TERMS_SQL = r"""
, fx_rq AS (
  SELECT request_id, language_code, title AS variant, """ + _TOK.format(c="title") + r""" AS qt FROM fx_requests
), fx_dt AS (
  SELECT page_id, language_code, title, text_body, """ + _TOK.format(c="title") + r""" AS tt,
         """ + _TOK.format(c="text_body") + r""" AS bt
  FROM fx_documents
), fx_tm AS (
  SELECT r.request_id, d.page_id, d.title, row_number() OVER (PARTITION BY r.request_id ORDER BY d.page_id) AS rn
  FROM fx_rq r JOIN fx_dt d ON d.language_code = r.language_code
  WHERE len(r.qt) > 0 AND list_has_all(d.tt, r.qt)
), fx_qt AS (
  SELECT request_id, language_code, variant, unnest(qt) AS t, len(qt) AS nt FROM fx_rq WHERE len(qt) > 0
), fx_bp AS (
  SELECT page_id, language_code, unnest(bt) AS t FROM fx_dt
), fx_bm0 AS (
  SELECT q.request_id, b.page_id FROM fx_qt q JOIN fx_bp b ON b.language_code = q.language_code AND b.t = q.t
  GROUP BY q.request_id, b.page_id, q.nt HAVING count(*) = q.nt
), fx_bm AS (
  SELECT r.request_id, r.variant, d.page_id, d.title, d.text_body, r.qt,
         row_number() OVER (PARTITION BY r.request_id ORDER BY d.page_id) AS rn
  FROM fx_bm0 m JOIN fx_rq r ON r.request_id = m.request_id
  JOIN fx_dt d ON d.page_id = m.page_id AND d.language_code = r.language_code
  WHERE d.title <> r.variant
), fx_rp AS (
  SELECT p.language_code, p.page_id, p.page_title, x.to_title
  FROM fx_pages p JOIN fx_redirections x ON x.from_page_id = p.page_id AND x.language_code = p.language_code
), fx_rc AS (
  SELECT r.request_id, p.page_id, replace(p.page_title, '_', ' ') AS from_title, p.to_title,
         row_number() OVER (PARTITION BY r.request_id ORDER BY p.page_id, p.to_title) AS rn
  FROM fx_requests r JOIN fx_rp p ON p.language_code = r.language_code
  WHERE p.page_title ILIKE '%' || (""" + _PAGE_KEY_SQL.format(c="r.title") + r""") || '%'
     OR p.page_title = """ + _PAGE_KEY_SQL.format(c="r.title") + r"""
)
"""


@query("title_terms_match", _TERMS_SQL + "SELECT request_id, page_id, title FROM fx_tm WHERE rn <= 20")
def title_terms_match_q(spark, sf_dir):
    from quire.operators import textsearch
    c, k = _single_k(spark, sf_dir)
    return _top(textsearch.title_matches(k, c, 20), ["page_id"]).select("request_id", "page_id", "title")


@query("body_terms_match", _TERMS_SQL + "SELECT request_id, page_id, title FROM fx_bm WHERE rn <= 20")
def body_terms_match_q(spark, sf_dir):
    from quire.operators import textsearch
    c, k = _single_k(spark, sf_dir)
    return _top(textsearch.body_matches(k, c, 20), ["page_id"]).select("request_id", "page_id", "title")


_SNIPPET_SQL = r"""
, fx_sn0 AS (
  SELECT request_id, page_id, text_body, qt,
         list_min(list_filter(list_transform(qt, lambda k: strpos(lower(text_body), k)), lambda p: p > 0)) AS first,
         array_to_string(list_transform(list_sort(list_transform(qt, lambda k: {'n': -length(k), 'k': k})),
                                        lambda s: s.k), '|') AS alt
  FROM fx_bm WHERE rn <= 20
), fx_sn1 AS (
  SELECT request_id, page_id, alt, len(qt) AS nk,
         replace(replace(replace(replace(substring(text_body, greatest(coalesce(first, 1) - 40, 1), 200),
                 '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS win
  FROM fx_sn0
), fx_sn2 AS (
  SELECT request_id, page_id,
         replace(replace(CASE WHEN nk > 0 THEN regexp_replace(win, '(?i)(' || alt || ')', '<span class="keyword">\1</span>', 'g')
                              ELSE win END, '<span class="keyword">', '**'), '</span>', '**') AS s
  FROM fx_sn1
)
SELECT request_id, page_id, CASE WHEN length(s) > 200 THEN substring(s, 1, 200) || '...' ELSE s END AS snippet
FROM fx_sn2
"""


@query("body_snippet", _TERMS_SQL + _SNIPPET_SQL)
def body_snippet_q(spark, sf_dir):
    from quire.operators import textsearch
    from quire.session import materialize
    c, k = _single_k(spark, sf_dir)
    hits = materialize(_top(textsearch.body_matches(k, c, 20), ["page_id"]).select("request_id", "language_code", "variant", "page_id"), "hits")
    return textsearch.with_snippets(hits, c.documents).select("request_id", "page_id", "snippet")


@query("redirect_contains", _TERMS_SQL + "SELECT request_id, page_id, from_title, to_title FROM fx_rc WHERE rn <= 20")
def redirect_contains_q(spark, sf_dir):
    from quire.operators import textsearch
    c, k = _single_k(spark, sf_dir, ("title_grams",))
    hits = textsearch.redirect_contains(k, c.pages, c.redirections, c.title_grams)
    return _top(hits, ["page_id", "to_title"]).select("request_id", "page_id", "from_title", "to_title")


@query("capped_hits", _TERMS_SQL + r"""
, fx_all AS (
  SELECT request_id, 0 AS phase, 3 AS stage, page_id, title, NULL AS from_title, NULL AS to_title FROM fx_tm
  UNION ALL SELECT request_id, 0, 4, page_id, NULL, from_title, to_title FROM fx_rc
  UNION ALL SELECT request_id, 1, 5, page_id, title, NULL, NULL FROM fx_bm
), fx_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY phase, stage, page_id, to_title) AS rank FROM fx_all
)
SELECT request_id, rank, stage, page_id, title, from_title, to_title FROM fx_ranked WHERE rank <= 20
""", ints=("stage",))
def capped_hits_q(spark, sf_dir):
    from quire.operators import cascade
    c, k = _single_k(spark, sf_dir, ("blocks", "title_grams"))
    hits = cascade.partial_hits(k, c, 20)
    return hits.select("request_id", "rank", "stage", "page_id", "title", "from_title", "to_title")


@query("search_rendered", SEARCH_SQL)
def search_rendered_q(spark, sf_dir):
    """The whole cascade with variants over every fixture request,
    rendered to response texts."""
    from quire.operators import cascade
    c = fx.corpus(spark, sf_dir, with_indexes=False).materialize()
    req = fx.fx_requests(c.documents).select("request_id", "title", "length", "languages")
    return cascade.render(cascade.search(req, c))


# --- S1-S9, R1 ---------------------------------------------------------------------

TALK_OFFSET = 2_000_000_000_000


@query("dump_pages_scan", "SELECT page_id, page_namespace, page_title, language_code FROM fx_pages",
       ints=("page_namespace",))
def dump_pages_scan_q(spark, sf_dir):
    """S2 over dump text that Spark writes from the fixture pages, with a
    talk page (namespace 1) beside every page and a redirect-table line
    mixed in; only namespace-0 pages come back."""
    from quire.sources import dumps
    pages = fx.fx_pages(fx.fx_documents(spark, sf_dir))
    talk = pages.select((F.col("page_id") + TALK_OFFSET).alias("page_id"), F.lit(1).alias("page_namespace"),
                        F.concat(F.lit("Talk_"), F.col("page_title")).alias("page_title"), "language_code")
    lines = dumps.dump_lines(pages.unionByName(talk), "page", "page_id", "page_namespace", "page_title")
    other = dumps.dump_lines(pages, "redirect", "page_id", "page_namespace", "page_title")
    return dumps.parse_page_lines(lines.unionByName(other), F.col("language_code")).drop("_order")


@query("dump_redirects_scan", "SELECT from_page_id, to_title, language_code FROM fx_redirections")
def dump_redirects_scan_q(spark, sf_dir):
    """S3 over dump text written from the fixture redirects."""
    from quire.sources import dumps
    r = fx.fx_redirections(fx.fx_documents(spark, sf_dir))
    lines = dumps.dump_lines(r, "redirect", "from_page_id", F.lit(0), "to_title")
    return dumps.parse_redirect_lines(lines, F.col("language_code"))


@query("first_wins_load", f"""
, fx_new AS (
  SELECT page_id, page_namespace, page_title, language_code, 0 AS ord FROM fx_pages
  UNION ALL
  SELECT page_id, page_namespace, 'Dup_' || page_title, language_code, 1 FROM fx_pages
), fx_first AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, language_code ORDER BY ord) AS rn FROM fx_new
)
SELECT page_id, page_namespace, page_title, language_code FROM fx_first f
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM fx_pages e
                             WHERE e.page_id = f.page_id AND e.language_code = f.language_code
                               AND e.page_id < {fx.ALIAS_OFFSET})
""", ints=("page_namespace",))
def first_wins_load_q(spark, sf_dir):
    """A batch holding every page twice (the second copy renamed) is
    loaded against a store that already holds the document pages: one row
    per key, the first copy, and nothing already stored."""
    from quire.plans.load import first_wins
    pages = fx.fx_pages(fx.fx_documents(spark, sf_dir))
    stored = pages.filter(F.col("page_id") < fx.ALIAS_OFFSET)
    new = pages.withColumn("ord", F.lit(0)).unionByName(
        pages.withColumn("page_title", F.concat(F.lit("Dup_"), "page_title")).withColumn("ord", F.lit(1)))
    out = first_wins(new, stored, ["page_id", "language_code"], "ord")
    return out.select("page_id", "page_namespace", "page_title", "language_code")


def _fixture_metadata(docs: DataFrame) -> DataFrame:
    """Language metadata of the fixture corpus, as typed CSV text."""
    from quire.sources.metadata import typed_metadata
    redir = fx.fx_redirections(docs).groupBy("language_code").agg(F.count(F.lit(1)).alias("redirections"))
    meta = (docs.groupBy("language_code").agg(F.count(F.lit(1)).alias("pages"),
                                              F.sum(F.length("text_body")).alias("size_bytes"))
            .join(redir, "language_code", "left"))
    raw = meta.select(F.col("language_code").alias("subset"), *[F.col(c).cast("string").alias(c)
                                                                for c in ("pages", "size_bytes", "redirections")],
                      F.lit(0).alias("_order"))
    return typed_metadata(raw)


PLAN_LANGS = ["en", "fr", "de", "es", "ja"]


@query("load_plan", r"""
, fx_meta AS (
  SELECT d.language_code AS subset, count(*) AS pages, sum(length(d.text_body)) AS size_bytes,
         (SELECT count(*) FROM fx_redirections r WHERE r.language_code = d.language_code) AS redirections
  FROM fx_documents d GROUP BY d.language_code
), fx_conf AS (
  SELECT unnest(['en', 'fr', 'de', 'es', 'ja']) AS language_code, unnest(range(5)) AS lang_rank
), fx_done AS (
  SELECT subset AS language_code, 'pages' AS dataset FROM fx_meta
  UNION ALL SELECT subset, 'documents' FROM fx_meta WHERE pages >= 120
), fx_plan AS (
  SELECT c.language_code, c.lang_rank, ds.dataset,
         CASE WHEN m.pages IS NULL THEN 'unavailable'
              WHEN d.language_code IS NOT NULL THEN 'complete' ELSE 'target' END AS status,
         CASE WHEN ds.dataset = 'redirections' THEN m.redirections ELSE m.pages END AS expected_rows
  FROM fx_conf c LEFT JOIN fx_meta m ON m.subset = c.language_code
  CROSS JOIN (SELECT unnest(['pages', 'documents', 'redirections']) AS dataset) ds
  LEFT JOIN fx_done d ON d.language_code = c.language_code AND d.dataset = ds.dataset
)
SELECT *,
  coalesce(sum(CASE WHEN dataset = 'documents' AND status <> 'unavailable' THEN expected_rows
                    WHEN dataset = 'redirections' AND status = 'target' THEN expected_rows END) OVER (PARTITION BY dataset), 0) AS total_items,
  coalesce(sum(CASE WHEN dataset = 'documents' AND status = 'complete' THEN expected_rows END) OVER (PARTITION BY dataset), 0) AS already_processed
FROM fx_plan
""", ints=("lang_rank", "expected_rows", "total_items", "already_processed"))
def load_plan_q(spark, sf_dir):
    """S1 + S9 + A1: metadata derived from the corpus (as CSV-like text,
    typed by S1), a manifest with pages complete everywhere and documents
    complete where a language has at least 120 documents, and the plan for
    five configured languages (one of them absent from the metadata)."""
    from quire.plans.load import load_plan
    typed = _fixture_metadata(fx.fx_documents(spark, sf_dir))
    done = (typed.select(F.col("subset").alias("language_code"), F.lit("pages").alias("dataset"), F.lit(True).alias("is_complete"))
            .unionByName(typed.filter(F.col("pages__n") >= 120).select(
                F.col("subset").alias("language_code"), F.lit("documents").alias("dataset"),
                F.lit(True).alias("is_complete"))))
    return load_plan(PLAN_LANGS, typed, done)


@query("load_corpus_run", """
, fx_stored AS (
  SELECT 'pages' AS dataset, language_code, page_id AS id, page_title AS value FROM fx_pages
  UNION ALL SELECT 'documents', language_code, page_id, title FROM fx_documents
  UNION ALL SELECT 'redirections', language_code, from_page_id, to_title FROM fx_redirections
)
SELECT * FROM fx_stored
UNION ALL SELECT 'flag ' || dataset, language_code, count(*), 'true' FROM fx_stored GROUP BY dataset, language_code
""")
def load_corpus_run_q(spark, sf_dir):
    """The whole load of the fixture corpus from sources that
    hold every key twice (the second copy renamed), begun on a store where
    the documents' own pages already lie without a flag (a half-finished
    load), then run again: the second run finds every language flagged."""
    from quire.plans.load import load_corpus, load_dataset, load_plan, read_manifest
    from quire.session import shared_dir
    docs = fx.fx_documents(spark, sf_dir)
    pages, redirections = fx.fx_pages(docs), fx.fx_redirections(docs)
    tables = {"pages": (pages, "page_id", "page_title"), "documents": (docs, "page_id", "title"),
              "redirections": (redirections, "from_page_id", "to_title")}
    out = shared_dir(spark, "corpus")

    def source(dataset, lang):
        df, key, value = tables[dataset]
        df = df.filter(F.col("language_code") == lang)
        if dataset == "redirections":
            return df
        again = df.withColumn(value, F.concat(F.lit("Dup "), value))
        return df.withColumn("_order", F.lit(0)).unionByName(again.withColumn("_order", F.lit(1)))

    sources = {(d, x): source(d, x) for d in tables for x in fx.LANGUAGES}
    half = pages.filter((F.col("language_code") == "en") & (F.col("page_id") < fx.ALIAS_OFFSET))
    load_dataset(spark, "pages", half.withColumn("_order", F.lit(0)), out, "en")
    for _ in range(2):
        plan = load_plan(fx.LANGUAGES, _fixture_metadata(docs), read_manifest(spark, out))
        flags = load_corpus(spark, plan, sources, out)
    parts = [spark.read.parquet(f"{out}/{d}").select(F.lit(d).alias("dataset"), "language_code",
                                                     F.col(key).alias("id"), F.col(value).alias("value"))
             for d, (_, key, value) in tables.items()]
    parts.append(flags.select(F.concat(F.lit("flag "), "dataset").alias("dataset"), "language_code",
                              F.col("n_rows").alias("id"), F.col("is_complete").cast("string").alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("search_stored", SEARCH_SQL)
def search_stored_q(spark, sf_dir):
    """The whole search over a corpus that was loaded into language
    partitions, with its stored indexes (S12)."""
    from quire.operators import cascade
    from quire.plans.load import build_indexes, load_dataset, open_corpus
    from quire.session import shared_dir
    docs = fx.stored_documents(spark, sf_dir)
    out = shared_dir(spark, "stored-corpus")
    tables = {"pages": fx.fx_pages(docs), "documents": docs, "redirections": fx.fx_redirections(docs)}
    for dataset, df in tables.items():
        for lang in fx.LANGUAGES:
            load_dataset(spark, dataset, df.filter(F.col("language_code") == lang).withColumn("_order", F.lit(0)), out, lang)
    build_indexes(spark, out, fx.LANGUAGES)
    req = fx.fx_requests(docs).select("request_id", "title", "length", "languages")
    return cascade.render(cascade.search(req, open_corpus(spark, out, list(fx.LANGUAGES))))


@query("or_terms_match", r"""
, fx_oq AS (
  SELECT page_id AS request_id, language_code, list_distinct(list_filter([
           lower(string_split(title, ' ')[1]), lower(string_split(title, ' ')[3])], lambda x: x IS NOT NULL AND regexp_full_match(x, '[\p{L}\p{N}]+'))) AS w
  FROM fx_documents
), fx_dt AS (
  SELECT page_id, language_code, title, """ + _TOK.format(c="title") + r""" AS tt FROM fx_documents
), fx_hit AS (
  SELECT q.request_id, d.page_id, row_number() OVER (PARTITION BY q.request_id ORDER BY d.page_id) AS rn
  FROM fx_oq q JOIN fx_dt d ON d.language_code = q.language_code WHERE len(q.w) > 0 AND list_has_any(d.tt, q.w)
)
SELECT request_id, page_id FROM fx_hit WHERE rn <= 20
""")
def or_terms_match_q(spark, sf_dir):
    """T2 with OR: the first and the third word of every title (where they
    are plain words) as alternatives."""
    from quire.operators import textsearch
    c, _ = _single_k(spark, sf_dir)
    w = F.filter(F.array(F.get(F.split("title", " "), F.lit(0)), F.get(F.split("title", " "), F.lit(2))),
                 lambda x: x.isNotNull() & x.rlike(r"\A[\p{L}\p{N}]+\z"))
    k = c.documents.select(F.col("page_id").alias("request_id"), F.lit(0).alias("variant_rank"),
                           F.lit(0).alias("lang_rank"), F.array_join(w, " OR ").alias("variant"), "language_code")
    return _top(textsearch.title_matches(k, c, 20), ["page_id"]).select("request_id", "page_id")


@query("phrase_terms_match", r"""
, fx_pq AS (
  SELECT page_id AS request_id, language_code, list_filter(regexp_extract_all(lower(text_body), '[\p{L}\p{N}]+'), lambda x: x <> '') AS tokens FROM fx_documents
), fx_ph AS (
  SELECT request_id, language_code, tokens[1] AS t1, tokens[2] AS t2, tokens[3] AS t3 FROM fx_pq WHERE len(tokens) >= 3
), fx_at AS (
  SELECT request_id AS page_id, language_code, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM fx_pq
), fx_three AS (
  SELECT a.page_id, a.language_code, a.t AS t1, lead(a.t) OVER w AS t2, lead(a.t, 2) OVER w AS t3 FROM fx_at a WINDOW w AS (PARTITION BY a.page_id, a.language_code ORDER BY a.i)
), fx_hit AS (
  SELECT DISTINCT p.request_id, h.page_id FROM fx_ph p JOIN fx_three h ON h.language_code = p.language_code AND h.t1 = p.t1 AND h.t2 = p.t2 AND h.t3 = p.t3
)
SELECT request_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY page_id) AS rn FROM fx_hit) WHERE rn <= 20
""")
def phrase_terms_match_q(spark, sf_dir):
    """T3 with phrases: the first three words of every body, quoted, found in
    bodies by the positions in the index; no text is read."""
    from quire.operators import blocks
    c, _ = _single_k(spark, sf_dir)
    words = F.slice(blocks.token_sequence("text_body", F.lit(False)), 1, 3)
    k = c.documents.select(F.col("page_id").alias("request_id"), "language_code", words.alias("w")).where(F.size("w") == 3)
    k = k.select("request_id", "language_code", F.concat(F.lit('"'), F.array_join("w", " "), F.lit('"')).alias("variant"))
    return blocks.block_matches(k, c.blocks, "body", n=20).select("request_id", "page_id")


@query("incremental_index_search", _TERMS_SQL + r"""
SELECT phase, request_id, page_id FROM fx_bm, (SELECT unnest(['replaced', 'merged']) AS phase)
WHERE rn <= 20
UNION ALL
SELECT 'first load', request_id, page_id FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY page_id) AS r FROM fx_bm WHERE page_id % 3 <> 0) WHERE r <= 20
""")
def incremental_index_search_q(spark, sf_dir):
    """A term index that grows by loads.  Two thirds of the documents are
    indexed and searched; the others are added, a third of them with their
    title for a body; these are then replaced by their real texts, and all is
    searched; last, all parts are merged and searched.  Body hits of the three states."""
    from quire.operators import textsearch
    from quire.operators.corpus import Corpus
    from quire.plans import segments
    from quire.session import shared_dir
    docs = fx.stored_documents(spark, sf_dir)
    req = fx.fx_requests(docs)
    k = req.select("request_id", F.col("title").alias("variant"), "language_code")
    out = shared_dir(spark, "growing-index")
    result = None

    def state(phase):
        index, dead = segments.open_index(spark, out)
        c = Corpus(documents=docs, pages=None, redirections=None, blocks=index, dead=dead)
        hits = textsearch.body_matches(k, c, 20).select(F.lit(phase).alias("phase"), "request_id", "page_id")
        return hits if result is None else result.unionByName(hits)

    segments.add_load(spark, out, docs.where("page_id % 3 <> 0"))
    result = state("first load")
    spoilt = F.col("page_id") % 9 == 0
    segments.add_load(spark, out, docs.where("page_id % 3 = 0").withColumn("text_body", F.when(spoilt, F.col("title")).otherwise(F.col("text_body"))))
    segments.add_load(spark, out, docs.where(spoilt), replace=True)
    result = state("replaced")
    segments.merge(spark, out, everything=True)
    result = state("merged")
    return result


@query("random_article_seeded", r"""
SELECT title, text_body FROM (
  SELECT * FROM fx_documents WHERE language_code IN ('en', 'fr')
  ORDER BY md5(CAST(page_id AS VARCHAR) || 'quire'), language_code, page_id LIMIT 1)
""")
def random_article_seeded_q(spark, sf_dir):
    """R1 with a seed: the sampling operator (LIMIT 1 is its feature)."""
    from quire.operators.sample import random_article
    return random_article(fx.fx_documents(spark, sf_dir), ["en", "fr"], seed="quire")


# --- S10, P1: streams ---------------------------------------------------------------

def _documents_stream(spark, sf_dir):
    from quire.streaming.loads import file_stream
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a pattern stands for a table of one file and for a folder of files alike
    return file_stream(spark, f"{sf_dir}/documents.parque[t]", schema)


def _as_fx_documents(df, *carry):
    head = F.regexp_extract("text", fx.TITLE_PATTERN, 1)
    title = F.when(head == "", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).otherwise(head)
    return df.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("language_code"),
                     title.alias("title"), F.col("text").alias("text_body"), *carry)


@query("resume_load_stream", "SELECT page_id, language_code, title, text_body FROM fx_documents")
def resume_load_stream_q(spark, sf_dir):
    """The documents file streamed into a language-partitioned table
    with first-wins batches, run twice on one checkpoint: the second run
    resumes and adds nothing.  Every document comes twice, the second copy
    renamed: the first one in source order wins."""
    from quire.session import shared_dir
    from quire.streaming.loads import load_stream
    target, ckpt = shared_dir(spark, "stream-docs"), shared_dir(spark, "stream-docs-ckpt")
    source = _documents_stream(spark, sf_dir)
    docs = _as_fx_documents(source, "_order").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(0))))
    title = F.when(F.col("copy") == 1, F.concat(F.lit("Again "), "title")).otherwise(F.col("title"))
    docs = docs.select("page_id", "language_code", title.alias("title"), "text_body", F.struct("_order", "copy").alias("_order"))
    for _ in range(2):
        load_stream(spark, docs, target, ckpt).awaitTermination()
    return spark.read.parquet(target).select("page_id", "language_code", "title", "text_body")


@query("request_stream_search", SEARCH_SQL)
def request_stream_search_q(spark, sf_dir):
    """Fixture requests derived from the streamed documents, answered
    per micro-batch by the cascade against the corpus and its indexes."""
    from quire.session import shared_dir
    from quire.streaming.requests import search_stream
    c = fx.corpus(spark, sf_dir, with_indexes=False).materialize()
    reqs = fx.fx_requests(_as_fx_documents(_documents_stream(spark, sf_dir))).select(
        "request_id", "title", "length", "languages")
    sink, ckpt = shared_dir(spark, "stream-answers"), shared_dir(spark, "stream-answers-ckpt")
    search_stream(spark, reqs, c, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).select("request_id", "status", "response")
