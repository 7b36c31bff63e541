"""Page and redirect tables from SQL dump files (``*.sql.gz``).

``spark.read.text`` decompresses gzip through the Hadoop codec (one task
per file: gzip does not split), then everything is column work: keep the
INSERT lines of the wanted table, pull every tuple out with
``regexp_extract_all``, zip the groups and explode.  Every tuple keeps its
place in the dump (``_order``), by which the first copy of a key wins; the
load's own shuffle spreads the rows of a single file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed

def _unescape(c: Column, escapes: str) -> Column:
    c = F.replace(c, F.lit("''"), F.lit("'"))
    if escapes == "mysql":
        c = F.regexp_replace(c, r"\\(.)", "$1")
    return c


def insert_tuples(lines: DataFrame, table: str, escapes: str = "mysql", carry: tuple[str, ...] = ()) -> DataFrame:
    """(n1, n2, title, _order) of every ``(int,int,'title'`` tuple on the
    INSERT lines of ``table``; ``lines`` has a ``value`` column (``carry``
    columns pass through).  ``_order`` is the tuple's place in the dump: the
    line's (``_line``, where given) and the place in the line."""
    prefix = f"INSERT INTO `{table}` VALUES"
    body = fixed.TITLE_BODY[escapes]
    pat = rf"\((\d+),(\d+),'({body})'"
    # bad UTF-8 bytes become U+FFFD; they are dropped
    v = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    line = F.col("_line") if "_line" in lines.columns else F.lit(None).cast("struct<file:string,line:bigint>")
    keep = lines.select(v.alias("value"), line.alias("_line"), *carry).filter(F.col("value").startswith(prefix))
    zipped = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(pat), i).alias(f"g{i}") for i in (1, 2, 3)])
    t = keep.select("_line", *carry, F.posexplode(zipped).alias("_pos", "t"))
    return t.select(*carry, F.col("t.g1").cast("long").alias("n1"), F.col("t.g2").cast("int").alias("n2"),
                    _unescape(F.col("t.g3"), escapes).alias("title"),
                    F.struct("_line", "_pos").alias("_order"))


def _carried(lines: DataFrame, language_code: str | Column) -> tuple[str, ...]:
    return tuple(c for c in ("language_code",) if isinstance(language_code, Column) and c in lines.columns)


def parse_page_lines(lines: DataFrame, language_code: str | Column, escapes: str = "mysql") -> DataFrame:
    """S2 on already-read lines: article pages (namespace 0) only."""
    t = insert_tuples(lines, "page", escapes=escapes, carry=_carried(lines, language_code))
    lang = language_code if isinstance(language_code, Column) else F.lit(language_code)
    return t.filter(F.col("n2") == 0).select(F.col("n1").alias("page_id"), F.col("n2").alias("page_namespace"),
                                             F.col("title").alias("page_title"), lang.alias("language_code"), "_order")


def parse_redirect_lines(lines: DataFrame, language_code: str | Column, escapes: str = "mysql") -> DataFrame:
    """S3 on already-read lines: every redirect, whatever the target
    namespace; the namespace is not kept."""
    t = insert_tuples(lines, "redirect", escapes=escapes, carry=_carried(lines, language_code))
    lang = language_code if isinstance(language_code, Column) else F.lit(language_code)
    return t.select(F.col("n1").alias("from_page_id"), F.col("title").alias("to_title"), lang.alias("language_code"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _line) of a dump's lines in their order: gzip files are read
    whole, one task each, so the running id of a task orders a file's lines."""
    lines = spark.read.text(path)
    return lines.select("value", F.struct(F.col("_metadata.file_path").alias("file"),
                                          F.monotonically_increasing_id().alias("line")).alias("_line"))


def watched(lines: DataFrame, table: str, seen: Observation | None) -> DataFrame:
    """The lines, with ``seen`` told on the first pass over them whether the
    statement that closes the table's part of a dump came (``whole``) -- a dump
    cut off anywhere lacks it."""
    if seen is None:
        return lines
    closing = F.col("value").startswith(fixed.DUMP_END.format(table=table))
    return lines.observe(seen, F.coalesce(F.max(closing), F.lit(False)).alias("whole"), F.count(F.lit(1)).alias("lines"))


def read_page_dump(spark: SparkSession, path: str, language_code: str, escapes: str = "mysql", seen: Observation | None = None) -> DataFrame:
    return parse_page_lines(watched(numbered_lines(spark, path), "page", seen), language_code, escapes)


def read_redirect_dump(spark: SparkSession, path: str, language_code: str, escapes: str = "mysql", seen: Observation | None = None) -> DataFrame:
    return parse_redirect_lines(watched(numbered_lines(spark, path), "redirect", seen), language_code, escapes)


def dump_lines(rows: DataFrame, table: str, id_col: str, ns_col: str | Column, title_col: str,
               per_line: int = 50, by: tuple[str, ...] = ("language_code",)) -> DataFrame:
    """Write-side helper: INSERT lines in dump layout for (id, namespace,
    title) rows, up to ``per_line`` tuples per line (ids bucketed), one
    dump per ``by`` group, MySQL-escaped titles."""
    ns = ns_col if isinstance(ns_col, Column) else F.col(ns_col)
    esc = F.replace(F.replace(F.col(title_col), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    tup = F.concat(F.lit("("), F.col(id_col).cast("string"), F.lit(","), ns.cast("string"), F.lit(",'"), esc,
                   F.lit("',0)"))
    t = rows.select(*by, F.col(id_col).alias("_id"), tup.alias("_t"), F.floor(F.col(id_col) / per_line).alias("_g"))
    return (t.groupBy(*by, "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_t"))),
                                                              lambda s: s["_t"]), ",").alias("_v"))
            .select(*by, F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.col("_v"), F.lit(";")).alias("value")))
