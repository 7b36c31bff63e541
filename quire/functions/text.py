"""Text keys, text units, tokens and snippet formatting as Columns.

Spark's ``trim`` only removes U+0020 and Java's ``\\s`` is ASCII unless
``(?U)`` is given, so every rule that mirrors a Python ``strip``/``split``
uses the Unicode-aware regexes below.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed

# Unicode-aware whitespace (Python str.isspace analogue on the JVM).
_WS_EDGES = r"(?U)\A\s+|\s+\z"
_WS_RUN = r"(?U)\s+"
# Script classes for CJK text (Java regex script names).
CJK_CLASS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
CJK_RUN = f"[{CJK_CLASS}]+"
WORD_RUN = rf"[\p{{L}}\p{{N}}&&[^{CJK_CLASS}]]+"
PLAIN_RUN = r"[\p{L}\p{N}]+"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, **values) -> Column:
    """A response text as a Column: ``{name}`` in ``template`` is replaced by
    the column (or column name) or literal given for it; a null makes it null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else col_of(values[x]) for i, x in enumerate(parts)])


def py_strip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(col_of(c), _WS_EDGES, "")


def first_upper(c) -> Column:
    """First character upper-cased, the rest unchanged ('' stays '')."""
    c = col_of(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def capitalize(c) -> Column:
    """``str.capitalize()``: first character in title case (``ß`` gives
    ``Ss``), all others lower."""
    c = col_of(c)
    first = F.upper(F.substring(c, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(first.substr(F.lit(2), F.length(first))),
                    F.lower(c.substr(F.lit(2), F.length(c))))


def page_key(c) -> Column:
    """Spaces to underscores and the first character upper-cased."""
    return first_upper(F.replace(col_of(c), F.lit(" "), F.lit("_")))


def document_key(c) -> Column:
    """Underscores to spaces, no change of case."""
    return F.replace(col_of(c), F.lit("_"), F.lit(" "))


def is_cjk(lang) -> Column:
    """The language code is one of the CJK codes (case-sensitive)."""
    return F.coalesce(col_of(lang).isin(*fixed.CJK_LANGUAGES), F.lit(False))


def word_count(c) -> Column:
    """``len(text.split())``: runs of Unicode whitespace separate words."""
    return F.size(F.filter(F.split(col_of(c), _WS_RUN), lambda w: w != ""))


def text_units(c, cjk) -> Column:
    """Code points for CJK text, whitespace-separated words otherwise."""
    return F.when(col_of(cjk), F.length(col_of(c))).otherwise(word_count(c))


def length_alias(c) -> Column:
    """``long`` is accepted as ``full``."""
    c = col_of(c)
    return F.when(c == "long", F.lit("full")).otherwise(c)


def format_snippet(c, max_chars: int = fixed.SNIPPET_MAX_CHARS) -> Column:
    """Keyword spans become ``**`` and the text is cut to ``max_chars``."""
    s = F.replace(F.replace(col_of(c), F.lit(fixed.SNIPPET_OPEN), F.lit("**")),
                  F.lit(fixed.SNIPPET_CLOSE), F.lit("**"))
    return F.when(F.length(s) > max_chars,
                  F.concat(F.substring(s, 1, max_chars), F.lit("..."))).otherwise(s)


def html_escape(c) -> Column:
    c = col_of(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# --- tokens ----------------------------------------------------------------

def word_terms(c) -> Column:
    """Lower-cased maximal runs of letters or digits outside CJK scripts."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(WORD_RUN), 0)


def cjk_runs(c) -> Column:
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(CJK_RUN), 0)


def cjk_bigrams(runs: Column) -> Column:
    """Overlapping character bigrams of each CJK run (a lone character
    stands for itself)."""
    return F.flatten(F.transform(
        runs,
        lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(r) - 1),
                        lambda i: F.substring(r, i, 2)))))


def terms(c, cjk=None) -> Column:
    """Distinct index terms of a text.  Text of a CJK language (``cjk``
    true): words outside CJK scripts plus bigrams of CJK runs.  Any other
    text: maximal runs of letters or digits.  Both sides of a match use the
    rule of the row's language; without ``cjk`` the CJK rule applies."""
    wide = F.array_distinct(F.concat(word_terms(c), cjk_bigrams(cjk_runs(c))))
    if cjk is None:
        return wide
    plain = F.array_distinct(F.regexp_extract_all(F.lower(col_of(c)), F.lit(PLAIN_RUN), 0))
    return F.when(col_of(cjk), wide).otherwise(plain)
