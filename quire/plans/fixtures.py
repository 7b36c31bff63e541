"""Corpus views derived from the driver's tables.

The driver's tables carry no titles, redirects or headings, so these views
derive them (see FIXTURES.md).  Each view exists twice: as DataFrame code
for Spark, and as SQL text used by the DuckDB oracle; both must give the
same rows.  Every view covers the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import document_key
from quire.session import materialize

# Redirect pages get ids past any document id.
ALIAS_OFFSET = 1_000_000_000_000
TITLE_PATTERN = r"^([^ \n]+ [^ \n]+ [^ \n]+)"
LANGUAGES = ["en", "fr", "de", "es"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head = F.regexp_extract("text", TITLE_PATTERN, 1)
    title = F.when(head == "", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).otherwise(head)
    return d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("language_code"),
                    title.alias("title"), F.col("text").alias("text_body"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_documents`` written once: what is derived from titles then reads
    titles, not the texts that they are cut from."""
    return materialize(fx_documents(spark, sf_dir), "fx-documents")


def _is_fallback(docs: DataFrame):
    return docs.title == F.concat(F.lit("Doc "), docs.page_id.cast("string"))


def fx_pages(docs: DataFrame) -> DataFrame:
    key = F.replace(docs.title, F.lit(" "), F.lit("_"))
    own = docs.select("page_id", F.lit(0).alias("page_namespace"), key.alias("page_title"), "language_code")
    alias = docs.select((docs.page_id + ALIAS_OFFSET).alias("page_id"), F.lit(0).alias("page_namespace"),
                        F.concat(F.lit("Alias_"), key).alias("page_title"), "language_code")
    return own.unionByName(alias)


def fx_redirections(docs: DataFrame) -> DataFrame:
    key = F.replace(docs.title, F.lit(" "), F.lit("_"))
    target = F.when(_is_fallback(docs), F.lit("Missing_Target")).otherwise(key)
    return docs.select((docs.page_id + ALIAS_OFFSET).alias("from_page_id"), target.alias("to_title"),
                       "language_code")


def fx_requests(docs: DataFrame) -> DataFrame:
    """Four requests per document: the title, its alias, its first six
    characters and a title that finds nothing."""
    k = docs.select("page_id", "title", "language_code",
                    F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("kind"))
    title = (F.when(k.kind == 0, k.title)
             .when(k.kind == 1, F.concat(F.lit("Alias "), k.title))
             .when(k.kind == 2, F.substring(k.title, 1, 6))
             .otherwise(F.concat(F.lit("zzqx "), k.page_id.cast("string"))))
    length = F.when(k.kind == 1, F.lit("short")).otherwise(F.lit("medium"))
    return k.select((k.page_id * 10 + k.kind).alias("request_id"), title.alias("title"),
                    length.alias("length"), F.col("language_code").alias("languages"),
                    "language_code")


def fx_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown article per conversation: a title line, then per turn a
    heading (``###`` on every third turn, else ``##``), a blank line and the
    turn text."""
    c = table(spark, sf_dir, "conversations")
    marks = F.when(c.turn % 3 == 2, F.lit("###")).otherwise(F.lit("##"))
    chunk = F.concat_ws("", marks, F.lit(" "), c.role, F.lit(" "), c.turn.cast("string"),
                        F.lit("\n\n"), c.text)
    per_turn = c.select("conv_id", "turn", chunk.alias("chunk"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "chunk"))),
                                    lambda s: s["chunk"]), "\n")
    return (per_turn.groupBy("conv_id")
            .agg(body.alias("body"))
            .select(F.col("conv_id").alias("page_id"), F.lit("und").alias("language_code"),
                    F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"),
                             F.col("body")).alias("text_body")))


def corpus(spark: SparkSession, sf_dir: str, with_indexes: bool = True):
    from quire.operators.corpus import Corpus
    docs = stored_documents(spark, sf_dir)
    c = Corpus(documents=docs, pages=fx_pages(docs), redirections=fx_redirections(docs),
               languages=list(LANGUAGES))
    return c.with_indexes() if with_indexes else c


# --- the same views as SQL for the DuckDB oracle ---------------------------

FIXTURE_SQL = rf"""
WITH fx_documents AS (
  SELECT doc_id AS page_id, lang AS language_code,
         CASE WHEN regexp_extract(text, '{TITLE_PATTERN}', 1) = ''
              THEN 'Doc ' || CAST(doc_id AS VARCHAR)
              ELSE regexp_extract(text, '{TITLE_PATTERN}', 1) END AS title,
         text AS text_body
  FROM documents
), fx_pages AS (
  SELECT page_id, 0 AS page_namespace, replace(title, ' ', '_') AS page_title, language_code FROM fx_documents
  UNION ALL
  SELECT page_id + {ALIAS_OFFSET}, 0, 'Alias_' || replace(title, ' ', '_'), language_code FROM fx_documents
), fx_redirections AS (
  SELECT page_id + {ALIAS_OFFSET} AS from_page_id,
         CASE WHEN title = 'Doc ' || CAST(page_id AS VARCHAR) THEN 'Missing_Target'
              ELSE replace(title, ' ', '_') END AS to_title,
         language_code
  FROM fx_documents
), fx_kinds AS (
  SELECT page_id, title, language_code, unnest([0, 1, 2, 3]) AS kind FROM fx_documents
), fx_requests AS (
  SELECT page_id * 10 + kind AS request_id,
         CASE kind WHEN 0 THEN title WHEN 1 THEN 'Alias ' || title
                   WHEN 2 THEN substring(title, 1, 6)
                   ELSE 'zzqx ' || CAST(page_id AS VARCHAR) END AS title,
         CASE kind WHEN 1 THEN 'short' ELSE 'medium' END AS length,
         language_code AS languages, language_code
  FROM fx_kinds
), fx_articles AS (
  SELECT conv_id AS page_id, 'und' AS language_code,
         '# Conversation ' || CAST(conv_id AS VARCHAR) || chr(10) ||
         string_agg(CASE WHEN turn % 3 = 2 THEN '###' ELSE '##' END || ' ' || role || ' ' ||
                    CAST(turn AS VARCHAR) || chr(10) || chr(10) || text, chr(10) ORDER BY turn) AS text_body
  FROM conversations GROUP BY conv_id
)
"""
