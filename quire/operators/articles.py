"""Articles cut to a length budget.

X1 ``article_blocks``: Markdown text -> one row per heading or block.  The
only Python on rows in the library: block boundaries (fences, lists,
tables) are a sequential state machine over the lines of one document, so
it runs in ``mapInPandas`` over whatever partitions the scan produced --
the text is never shuffled for it.

X2-X6 are relational over the blocks: one repartition by (document,
length), then windows and aggregations whose keys all extend that
partitioning, so Spark adds no further exchange.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import fixed
from quire.functions.text import fill, is_cjk, text_units

BLOCK_SCHEMA = T.StructType([
    T.StructField("language_code", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("block_no", T.IntegerType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("is_special", T.BooleanType()),
    T.StructField("heading_no", T.IntegerType()),
    T.StructField("idx_in_heading", T.IntegerType()),
    T.StructField("ancestors", T.ArrayType(T.IntegerType())),
])

_HEADING = re.compile(fixed.HEADING_PATTERN)
_LIST_ITEM = re.compile(fixed.LIST_MARKER_PATTERN)


def _segments(text: str):
    """Yield (first_line, kind, level, title, content) in document order.

    Modes: ``None`` between blocks; ``fence`` until a line opening with the
    fence mark (inclusive, or the end); ``list`` until a blank line;
    ``table`` until a line without a pipe (that line starts afresh)."""
    lines = text.split("\n")
    mode, first = None, 0
    for no, line in enumerate(lines):
        bare = line.strip()
        if mode == "fence":
            if bare.startswith(fixed.FENCE_MARK):
                yield first, "para", None, None, "\n".join(lines[first:no + 1])
                mode = None
            continue
        if mode == "list":
            if bare:
                continue
            yield first, "para", None, None, "\n".join(lines[first:no])
            mode = None
            continue
        if mode == "table":
            if "|" in line:
                continue
            yield first, "para", None, None, "\n".join(lines[first:no])
            mode = None
        m = _HEADING.match(line)
        if m:
            yield no, "heading", len(m.group(1)), m.group(2).strip(), line
        elif not bare:
            continue
        elif bare.startswith(fixed.FENCE_MARK):
            mode, first = "fence", no
        elif _LIST_ITEM.match(line):
            mode, first = "list", no
        elif "|" in line:
            mode, first = "table", no
        else:
            yield no, "para", None, None, line
    if mode is not None:
        yield first, "para", None, None, "\n".join(lines[first:])


def blocks_of(text: str) -> list[tuple]:
    """Blocks of one text with their place in the heading tree.

    The open path is a stack of (level, heading_no, special); a new heading
    closes every open heading of the same or a deeper level.  A block hangs
    under the innermost open heading (0 = root)."""
    out = []
    path: list[tuple[int, int, bool]] = []
    seen_level2 = False
    per_heading: dict[int, int] = {}
    n_headings = 0
    for block_no, (first, kind, level, title, content) in enumerate(_segments(text or "")):
        if kind == "heading":
            n_headings += 1
            while path and path[-1][0] >= level:
                path.pop()
            special = level == 2 and not seen_level2
            seen_level2 = seen_level2 or level == 2
            ancestors = [h for _, h, _ in path]
            path.append((level, n_headings, special))
            out.append((block_no, first, kind, level, title, content, special, n_headings, None, ancestors))
        else:
            lvl, h, special = path[-1] if path else (0, 0, False)
            idx = per_heading.get(h, 0)
            per_heading[h] = idx + 1
            out.append((block_no, first, kind, lvl, None, content, special, h, idx, [x for _, x, _ in path]))
    return out


def _blocks_batches(batches):
    cols = [f.name for f in BLOCK_SCHEMA.fields]

    def frame(rows):
        out = pd.DataFrame.from_records(rows, columns=cols)
        for c in ("block_no", "line_start", "level", "heading_no", "idx_in_heading"):
            out[c] = out[c].astype("Int32")
        return out

    for pdf in batches:
        rows = []
        for lang, pid, text in zip(pdf["language_code"], pdf["page_id"], pdf["text_body"]):
            rows += [(lang, pid) + b for b in blocks_of(text)]
            if len(rows) >= BLOCKS_HELD:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)


#: Blocks that a Python worker holds before it hands them on.
BLOCKS_HELD = 4000


def article_blocks(documents: DataFrame) -> DataFrame:
    """Documents (language_code, page_id, text_body) -> blocks."""
    return documents.select("language_code", "page_id", "text_body").mapInPandas(_blocks_batches, BLOCK_SCHEMA)


# --- X2 ----------------------------------------------------------------------

def _priority_order(*doc: str) -> Window:
    return Window.partitionBy(*doc).orderBy(
        F.col("level"), F.col("is_special").desc(), F.col("idx_in_heading"), F.col("heading_no"))


def block_priorities(blocks: DataFrame, doc=("language_code", "page_id")) -> DataFrame:
    """Reading priority of each paragraph: root paragraphs first, then
    level by level; inside a level the special heading's paragraphs, then
    the others round-robin (first paragraph of each heading in document
    order, then the second, ...)."""
    paras = blocks.filter(F.col("kind") == "para")
    return paras.withColumn("priority", F.row_number().over(_priority_order(*doc)))


# --- X3-X6 -------------------------------------------------------------------

def _limit(length: Column, cjk: Column) -> Column:
    expr = None
    for name, (plain, wide) in fixed.LENGTH_LIMITS.items():
        v = F.when(cjk, F.lit(wide)).otherwise(F.lit(plain))
        expr = F.when(length == name, v) if expr is None else expr.when(length == name, v)
    return expr.otherwise(F.lit(None))


def _plain_headings(c: Column) -> Column:
    """Every line that is a Markdown heading becomes its stripped text."""
    ws = r"[^\S\n]"  # whitespace inside one line
    return F.regexp_replace(c, rf"(?mdU)^#{{1,6}}(?:{ws}+(\S.*?){ws}*|{ws}{ws}+)$", "$1")


DOC = ["language_code", "page_id", "length"]


def _selection(blocks: DataFrame, targets: DataFrame):
    """X3 in closed form, windows only.

    Each heading is paid for by the first paragraph (in priority order)
    below it; a paragraph's cost is its units plus the headings it pays
    for; the kept paragraphs are those whose running cost stays within the
    limit, and always the first.  Because the kept set is a prefix of the
    priority order, a heading is required exactly when its first paragraph
    is at or before the last kept one.

    One repartition by (document, length); every window below is keyed by
    a superset of it, so Spark adds no other exchange.  Returns (cut
    targets, rows) where rows are paragraphs (with ``keep``) and headings
    (with ``required``)."""
    doc = DOC
    cut = targets.filter(F.col("length") != "full").select(*doc).distinct()
    b = (blocks.join(cut, ["language_code", "page_id"], "inner")
         .repartition(*doc))
    cjk = is_cjk("language_code")
    b = b.withColumn("units", text_units("content", cjk))
    is_para = F.col("kind") == "para"
    # paragraphs numbered first (headings sort after them and get no number)
    order = Window.partitionBy(*doc).orderBy(
        (~is_para).asc(), F.col("level"), F.col("is_special").desc(), F.col("idx_in_heading"), F.col("heading_no"))
    b = b.withColumn("priority", F.when(is_para, F.row_number().over(order)))
    # one generator, so the partitioning survives: a paragraph yields a row
    # per enclosing heading (pos 0 or null marks its own row), a heading
    # yields one row for itself
    owners = F.when(is_para, F.col("ancestors")).otherwise(F.array(F.col("heading_no")))
    # the text stays with a paragraph's first row; its other rows only count
    u = b.select(*doc, "kind", "line_start", "content", "level", "title", "heading_no", "units", "priority",
                 F.posexplode_outer(owners).alias("pos", "h"),
                 F.when(~is_para, F.col("units")).alias("h_units"))
    u = u.withColumn("content", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("content")))
    by_heading = Window.partitionBy(*doc, "h")
    u = (u.withColumn("first_priority", F.min("priority").over(by_heading))
         .withColumn("heading_units", F.max("h_units").over(by_heading)))
    pays = F.when((F.col("priority") == F.col("first_priority")) & F.col("h").isNotNull()
                  & (F.col("kind") == "para"), F.coalesce(F.col("heading_units"), F.lit(0))).otherwise(0)
    u = u.withColumn("charge", F.sum(pays).over(Window.partitionBy(*doc, "priority")))
    rows = u.filter((F.col("kind") == "heading") | F.col("pos").isNull() | (F.col("pos") == 0))
    cost = F.when(is_para, F.col("units") + F.col("charge")).otherwise(0)
    running = Window.partitionBy(*doc).orderBy(F.col("priority").asc_nulls_first(), "line_start").rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.sum(cost).over(running))
    rows = rows.withColumn("keep", is_para & ((F.col("running") <= _limit(F.col("length"), cjk))
                                              | (F.col("priority") == 1)))
    whole = Window.partitionBy(*doc)
    rows = (rows.withColumn("last_priority", F.max(F.when(F.col("keep"), F.col("priority"))).over(whole))
            .withColumn("required", (F.col("kind") == "heading")
                        & F.coalesce(F.col("first_priority") <= F.col("last_priority"), F.lit(False))))
    return cut, rows


def _parts(rows: DataFrame) -> DataFrame:
    """Per document: the kept text, the omitted-heading list and whether a
    paragraph was left out -- one aggregation on the document key."""
    shown = F.col("keep") | F.col("required")
    bullet = F.concat(F.repeat(F.lit("  "), F.col("level") - 2), F.lit("- "), F.col("title"))
    omit = (F.col("kind") == "heading") & ~F.col("required") & (F.col("level") >= 2)
    agg = rows.groupBy(*DOC).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("line_start", "content")))),
                                 lambda s: s["content"]), "\n\n").alias("body"),
        F.collect_list(F.when(omit, F.struct("heading_no", bullet.alias("b")))).alias("_omit"),
        F.sum(F.when(F.col("kind") == "para", 1).otherwise(0)).alias("n_paras"),
        F.sum(F.when(F.col("keep"), 1).otherwise(0)).alias("n_kept"))
    omitted = F.when(F.size("_omit") > 0, F.array_join(F.transform(F.array_sort("_omit"), lambda s: s["b"]), "\n"))
    return agg.withColumn("omitted", omitted).drop("_omit")


def omitted_headings(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Headings of level 2 or more that the cut leaves out, as an
    indented bullet list in document order (documents with none are
    absent)."""
    _, rows = _selection(blocks, targets)
    return _parts(rows).filter(F.col("omitted").isNotNull()).select(*DOC, "omitted")


def target_blocks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """X1 for the documents that a target cuts: other texts are neither
    parsed nor moved."""
    wanted = targets.filter(F.col("length") != "full").select("language_code", "page_id").distinct()
    return article_blocks(documents.join(wanted, ["language_code", "page_id"], "left_semi"))


def extract(documents: DataFrame, targets: DataFrame, tool_name: str = fixed.DEFAULT_TOOL_NAME) -> DataFrame:
    """The text of each target cut to its length budget.

    ``targets``: (language_code, page_id, length) with length one of
    ``fixed.LENGTHS``; ``full`` rows are answered unchanged.  Returns
    (language_code, page_id, length, article_text)."""
    doc = DOC
    cut, rows = _selection(target_blocks(documents, targets), targets)
    out = cut.join(_parts(rows), doc, "left")
    text = F.coalesce(F.col("body"), F.lit(""))
    larger = F.when(F.col("length") == "short", F.lit("medium")).otherwise(F.lit("full"))
    hint = fill(fixed.READ_MORE, tool=F.lit(tool_name), larger=larger)
    tail = F.concat(
        F.when(F.col("omitted").isNotNull(),
               F.concat(F.lit(fixed.OMITTED_TITLE + "\n"), F.col("omitted"))).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("n_kept"), F.lit(0)) < F.coalesce(F.col("n_paras"), F.lit(0)), hint)
        .otherwise(F.lit("")))
    article = F.when(F.col("length") == "very-short", _plain_headings(text)).otherwise(F.concat(text, tail))
    result = out.select(*doc, article.alias("article_text"))
    full = (targets.filter(F.col("length") == "full").select(*doc).distinct()
            .join(documents.select("language_code", "page_id", F.col("text_body").alias("article_text")),
                  ["language_code", "page_id"], "inner"))
    return result.unionByName(full)
