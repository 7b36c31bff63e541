"""A page's block structure: a small, forgiving HTML reader (operator 10).

Elements that only mark up a line (links, emphasis, spans, formulas) are part of
the block around them, unless their names are those of a page's boilerplate;
every other element is a node of a tree.  A node
owns runs of text, in page order; a run ends where a child block begins.  Raw
elements (scripts, styles) and comments have no text; what else a page may hide
(noscript, object, canvas, svg) is left to the model.  Unclosed elements end as
browsers end them: a paragraph where a block begins, a list item at the next,
everything at the end of the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

from quire.llm.labelled import PARTS

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
RAW_END = {name: re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements in which `/>` ends an element, and their parts that hold HTML again.
FOREIGN = frozenset({"svg", "math"})
HTML_AGAIN = frozenset({"foreignobject", "annotation-xml"})
FOREIGN_START = re.compile(r"<(?:svg|math)\b", re.I)
#: Elements of running text, names of boilerplate, and those of them that hold within running text too.
SAYS = frozenset("p li dd dt h1 h2 h3 h4 h5 h6 td th blockquote pre figcaption caption".split())
BOILERPLATE = frozenset(w for part in PARTS.values() for w in part.split())
ALWAYS = frozenset("ad ads advert advertisement adsense dfp affiliate sponsor sponsored sponsorship promo promotion share sharing social cookie cookies consent newsletter subscribe subscription "
                   "breadcrumb breadcrumbs pagination pager skip navbar navigation nav menu disqus popup modal byline meta".split())
#: What a beginning element ends, and the elements that shield from that.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Elements that an open paragraph does not survive.
BREAKS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
MARKING = re.compile(r"\b(?:class|id|role|data-main)\b", re.I)


@dataclass
class Page:
    """Nodes in page order, the root first."""
    tag: list[str]
    parent: list[int]
    names: list[list[str]]
    """Words of each node's class, id and role."""
    runs: list[tuple[int, str]]
    """(node, text) with references decoded and white space as one space."""
    linked: list[int]
    """Characters of each node's own text within links."""
    mark: list[str | None]
    """The `data-main` attribute, by which labelled pages say what is content."""


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]


def read_page(html: str) -> Page:
    page = Page(["#root"], [-1], [[]], [], [0], [None])
    # Open elements: (name, node); an inline element's node is the block's.
    stack: list[tuple[str, int]] = [("#root", 0)]
    text: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                page.runs.append((stack[-1][1], said))
                page.linked[stack[-1][1]] += linked
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        if any(node != stack[depth - 1][1] for _, node in stack[depth:]):
            flush()
        links -= sum(name == "a" for name, _ in stack[depth:])
        del stack[depth:]

    def close_open(names: set[str] | frozenset[str], shield: set[str] | frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                lowest = depth
                while lowest > 1 and stack[lowest - 1][0] in names:
                    lowest -= 1
                close(lowest)
                return
            if stack[depth][0] in shield:
                return

    foreign = FOREIGN_START.search(html) is not None
    at = 0
    while at < len(html):
        found = TOKEN.search(html, at)
        plain = html[at:found.start() if found else len(html)]
        if plain:
            text.append(plain)
            if links:
                linked += len(plain)
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        name, attributes = found[2].lower(), found[3]
        if not found[4]:  # the page ends within a tag
            break
        if found[1]:
            if name == "br":
                text.append(" ")
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break  # an inline end tag does not close blocks
            continue
        within = next((x for x, _ in reversed(stack) if x in FOREIGN or x in HTML_AGAIN), None) if foreign else None
        if name in BREAKS_P and within in FOREIGN:
            while any(x in FOREIGN for x, _ in stack) and within in FOREIGN:
                close(max(i for i, (x, _) in enumerate(stack) if x in FOREIGN))
                within = next((x for x, _ in reversed(stack) if x in FOREIGN or x in HTML_AGAIN), None)
        if (name in FOREIGN or within in FOREIGN) and attributes.rstrip().endswith("/"):
            continue
        if name in BREAKS_P:
            close_open({"p"}, {"button", "table", "td", "th"})
        if name in ENDS:
            close_open(*ENDS[name])
        if name in VOID:
            text.append(" ") if name in ("br", "hr", "img", "input") else None
            continue
        said = dict((k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)) if MARKING.search(attributes) else {}
        names = [w for k in ("class", "id", "role") for w in _words(said.get(k, ""))]
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            text.append(" ")
            continue
        marked = "data-main" in said or not ALWAYS.isdisjoint(names) or not (
            BOILERPLATE.isdisjoint(names) or page.tag[stack[-1][1]] in SAYS or any(x.strip() for x in text))
        if name == "math" or within == "math" or name in INLINE and (name == "a" or not marked):
            if name == "a":
                links += 1
            stack.append((name, stack[-1][1]))
        else:
            flush()
            page.tag.append(name)
            page.parent.append(stack[-1][1])
            page.names.append(names)
            page.linked.append(0)
            page.mark.append(said.get("data-main"))
            stack.append((name, len(page.tag) - 1))
    flush()
    return page
