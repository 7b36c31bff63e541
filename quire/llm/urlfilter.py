"""URL filters by redirect equivalence (operator 11).

Rules (host, path, verdict) judge a URL whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path; the longest rule
(host and path together) wins, allow before block among equal ones.  A URL that
no rule fits gets its decision from its aliases:

1. Edges lead from a page to the target of its redirects (``<meta
   http-equiv=refresh>``, and a table of logged redirects if given) and to its
   canonical address (``<link rel=canonical>``).  Targets are resolved against
   ``<base href>`` and the page's URL.
2. URLs without their fragment are the nodes.  Distinct edges are numbered and
   their connected components found by pointer jumping on written tables.
3. Rules judge every node, also targets that are no page.  A component with an
   explicitly allowed node is allowed; otherwise one with a blocked node is
   blocked; any other one is allowed.  Only nodes without a rule of their own
   take the component's decision.

Nothing is collected: edges are made distinct before they are joined, the
component's decision is an aggregate, and pages meet only the blocked nodes.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule, is no node and is allowed; null html has no edges; pages with the
same URL share its node and decision, whatever their number; targets that are
no URL with a host are left out.  Edges inside comments, scripts, styles and
text areas do not count.  Other columns are not read.  Empty input: empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import components
from quire.session import materialize

ALLOW, BLOCK = "allow", "block"

#: (host, path, verdict)
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))

#: Host and path of a URL; the scheme ends at the first `://`.
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"

#: What the tag scan steps over, and the tags it reads.  Quantifiers are possessive: a text is read once.
TAGS = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe)\b.*?(?:</\1|\Z)|<(link|meta|base)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.S)
REFRESH = re.compile(r"""^[\s\d.]*[;,]?\s*url\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""", re.S | re.I)


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower_ascii(F.regexp_extract(url, URL, 2)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL without its fragment, scheme and host lower-cased; null if it has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(_lower_ascii(F.regexp_extract(url, URL, 1)), F.lit("://"), host_of(url), rest))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The winning rule as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != ALLOW, r[0]))
    out = F.lit(None)
    for rule_host, rule_path, verdict in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def page_targets(url: str, source: str) -> list[str]:
    """Absolute targets of a page's redirects and canonical links, in page order."""
    base, found = url, []
    for tag in TAGS.finditer(source):
        if not tag[2]:
            continue
        said = {}
        for a in ATTRIBUTE.finditer(tag[3]):
            said.setdefault(a[1].lower(), html.unescape(next(x for x in a.groups()[1:] if x is not None)).strip())
        kind, target = tag[2].lower(), None
        if kind == "base":
            base = _joined(url, said.get("href")) or base
        elif kind == "link" and "canonical" in said.get("rel", "").lower().split():
            target = said.get("href")
        elif kind == "meta" and said.get("http-equiv", "").lower() == "refresh":
            at = REFRESH.match(said.get("content", ""))
            target = at and next(x for x in at.groups() if x is not None).strip()
        if target and (target := _joined(base, target)):
            found.append(target)
    return found


def _joined(base: str, target: str | None) -> str | None:
    if not target:
        return None
    try:
        return urljoin(base, target)
    except ValueError:  # no address, for instance an open bracket in the host
        return None


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) of all redirect and canonical links; only pages that name one are read in Python."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u.as_py(), t) for u, h in zip(batch["u"], batch["h"], strict=True) for t in page_targets(u.as_py(), h.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["source", "target"])

    marked = pages.where((host_of(F.col(url_col)) != "") & F.col(html_col).rlike("(?i)canonical|refresh"))
    return marked.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, "source string, target string")


def blocked_aliases(edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Nodes (node) without a rule of their own that their aliases block.
    ``edges``: (source, target) URLs."""
    ends = edges.select(node_of(F.col("source")).alias("x"), node_of(F.col("target")).alias("y")).where("x <> y").distinct()
    ends = materialize(ends, "edges")
    names = ends.select(F.col("x").alias("node")).union(ends.select(F.col("y").alias("node"))).distinct()
    nodes = materialize(names.withColumn("id", F.monotonically_increasing_id()), "nodes")
    links = ends.join(nodes.select(F.col("node").alias("x"), F.col("id").alias("a")), "x").join(nodes.select(F.col("node").alias("y"), F.col("id").alias("b")), "y")
    found = components(links.select("a", "b"))
    judged = nodes.join(found, "id").select("node", "component", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("verdict"))
    judged = materialize(judged, "judged")
    decided = judged.groupBy("component").agg(F.max(F.col("verdict").eqNullSafe(ALLOW)).alias("allowed"), F.max(F.col("verdict").eqNullSafe(BLOCK)).alias("blocked"))
    return judged.where("verdict IS NULL").join(decided.where("blocked AND NOT allowed").select("component"), "component", "left_semi").select("node")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id_col, host, path, rule, verdict) per row of ``pages``.
    ``redirects``: logged redirects (source, target), if any."""
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    blocked = materialize(blocked_aliases(materialize(edges.distinct(), "links"), rules), "blocked")
    url = F.col("u")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    rows = rows.select("id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(blocked.withColumn("alias_blocked", F.lit(True)), "node", "left")
    verdict = F.coalesce("fits.verdict", F.when(F.col("alias_blocked"), BLOCK).otherwise(ALLOW))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"))
