"""Labelled pages to train the content model: made by rule, from parts that web
pages are commonly built of.  `data-main` marks content (1) and the rest (0);
elements without it take their parent's label."""

from __future__ import annotations

import random

#: Words of class names that say what a part of a page is (fixed values).
PARTS = {
    "menu": "menu nav navigation navbar topbar breadcrumb breadcrumbs tabs pagination pager toc skip links",
    "header": "header masthead banner top logo branding site title tagline",
    "footer": "footer bottom colophon copyright legal credits imprint",
    "sidebar": "sidebar aside side widget rail related recommended popular trending archive tags more",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay privacy message warning info toast",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp affiliate offer sponsorship banner",
    "form": "form login signin signup subscribe subscription newsletter search contact register comment respond",
    "share": "share social sharing follow twitter facebook buttons tools actions print meta byline author date",
    "comments": "comments comment reply replies discussion disqus thread responses reader feedback remark",
}
CONTENT = "content article post entry body text main story page story hentry prose copy document single blog"
SYLLABLES = "an be ro ti la mon ver sta ing ou re chi der en qua es lo mi tion sa".split()
LABELS = "Home About Contact Archive News Help Login Register Search Share Print Next Previous Privacy Terms Subscribe Reply More Top".split()


def _sentence(r: random.Random, low: int = 3, high: int = 24) -> str:
    said = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    if len(said) > 8 and r.random() < 0.5:
        said[r.randrange(3, len(said) - 2)] += ","
    return " ".join(said).capitalize() + r.choice(["."] * 8 + ["?", "!", ""])


def _prose(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 8, r.choice([8, 40])])))


def _named(r: random.Random, words: str) -> str:
    own = r.sample(words.split(), r.randint(1, 2))
    name = r.choice(["-", "_", " "]).join(own)
    return f' {r.choice(["class", "class", "id"])}="{name}"'


def _link(r: random.Random, text: str) -> str:
    return f'<a href="/{r.randrange(999)}">{text}</a>'


def _item(r: random.Random) -> str:
    return _link(r, r.choice(LABELS) if r.random() < 0.5 else _sentence(r, 1, 6))


def _other(r: random.Random, part: str, inside: bool) -> str:
    """One part of a page that is not content."""
    name = _named(r, PARTS[part])
    if part == "menu":
        tag = r.choice(["nav", "nav", "div", "ul"])
        items = [_item(r) for _ in range(r.randint(2, 9))]
        body = "".join(f"<li>{i}</li>" for i in items) if tag == "ul" else f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if r.random() < 0.7 else " | ".join(items)
        name = name if tag == "div" or r.random() < 0.4 else ""
    elif part == "header":
        tag = "div" if inside else r.choice(["header", "header", "div"])
        body = r.choice(["", f"<h1>{_sentence(r, 1, 4)}</h1>", f"<h2>{_sentence(r, 1, 4)}</h2>"]) + r.choice(["", f"<p>{_sentence(r)}</p>", f"<div>{_item(r)}</div>"])
    elif part == "footer":
        tag = r.choice(["footer", "footer", "div"])
        said = f"&copy; {r.choice(SYLLABLES)}.example.com {r.choice(['&middot; ', ''])}{_sentence(r)} {r.choice(['', _prose(r)])}"
        body = r.choice([said, f"<p>{said}</p>", f"<p>{said}</p><ul><li>{_item(r)}</li><li>{_item(r)}</li></ul>", f"<div>{said}</div><p>{_prose(r)}</p>"])
        name = name if tag == "div" or r.random() < 0.3 else ""
    elif part == "sidebar":
        tag = r.choice(["aside", "aside", "div", "section"])
        body = f"<h3>{_sentence(r, 1, 4)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{_item(r)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{_prose(r)}</p>", f"<div><h4>{_item(r)}</h4><p>{_sentence(r)}</p></div>"])
        name = name if tag != "aside" or r.random() < 0.4 else ""
    elif part == "form":
        tag = r.choice(["form", "form", "div"])
        body = r.choice([f"<label>{_sentence(r, 1, 3)}</label><input name=q><button>{r.choice(LABELS)}</button>", f"<p>{_prose(r)}</p><input><button>{r.choice(LABELS)}</button>", f"<fieldset><legend>{_sentence(r, 1, 3)}</legend><label>{r.choice(LABELS)}</label></fieldset>"])
        body = f"<form>{body}</form>" if tag == "div" and r.random() < 0.6 else body
        name = name if tag == "div" or r.random() < 0.4 else ""
    elif part == "comments":
        tag = r.choice(["div", "section", "ol", "aside"])
        own = "li" if tag == "ol" else r.choice(["div", "article"])
        one = lambda: f'<{own}{_named(r, PARTS["comments"])}>{r.choice(["", f"<h4>{_sentence(r, 1, 2)}</h4>", f"<cite>{_sentence(r, 1, 2)}</cite>"])}<p>{_prose(r)}</p>{r.choice(["", _link(r, "Reply")])}</{own}>'
        body = r.choice(["", f"<h3>{r.randrange(40)} {_sentence(r, 1, 2)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 4)))
    else:
        tag = r.choice(["div", "div", "div", "p", "section", "aside", "span"])
        body = r.choice([_sentence(r), _prose(r), _item(r), f"{_sentence(r)} {_item(r)}"])
        if tag in ("div", "section", "aside") and r.random() < 0.5:
            body = f"<p>{body}</p>" + r.choice(["", f"<button>{r.choice(LABELS)}</button>", f"<div>{_item(r)}</div>"])
    return f'<{tag}{name} data-main="0">{body}</{tag}>'


def _block(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.62:
        said = _prose(r)
        said = r.choice([said] * 5 + [f"<b>{said}<br>", f"<em>{_sentence(r)}</em> {said}", f"{said} {_link(r, _sentence(r, 1, 4))}", f"<strong>{said}</strong>"])
        return f"<p>{said}" + r.choice(["</p>"] * 5 + [""])
    if kind < 0.74:
        level = r.randint(2, 4)
        return f"<h{level}>{_sentence(r, 1, 8)}</h{level}>"
    if kind < 0.82:
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
    if kind < 0.88:
        return f"<blockquote>{r.choice(['', '<p>'])}{_prose(r)}</blockquote>"
    if kind < 0.92:
        return f"<pre>{_sentence(r)}</pre>"
    if kind < 0.96:
        return "<table>" + "".join(f"<tr><td>{_sentence(r, 1, 4)}</td><td>{_sentence(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
    return f"<div><p>{_prose(r)}</p></div>" if r.random() < 0.5 else f"<figure><img src=x><figcaption>{_sentence(r)}</figcaption></figure>"


#: Names of boxes within articles, and of grids (fixed values).
BOXES = "note box lead intro chapter section example tip quote figure summary abstract part highlight"
GRIDS = "container wrapper row grid col column columns col-8 col-9 col-md-8 col-lg-9 left center middle inner outer page layout"
#: Where the content of a page stands.
SHAPES = ("named", "body", "grid", "nameless", "breaks", "pre", "boxes", "table")


def _box(r: random.Random) -> str:
    inner = "".join(_block(r) for _ in range(r.randint(1, 3)))
    return r.choice([f"<div{_named(r, BOXES)}>{inner}</div>", f"<section>{inner}</section>", f"<div>{inner}</div>", f"<section><h3>{_sentence(r, 1, 6)}</h3>{inner}</section>"])


def _shaped(r: random.Random, shape: str, head: str, blocks: list[str], side: str) -> tuple[str, bool]:
    """The marked content in one of SHAPES, and whether the body itself holds it."""
    inside = head + "".join(blocks)
    mark = ' data-main="1"'
    if shape == "body":
        return inside, True
    if shape == "pre":
        return f"<pre{mark}>" + "\n".join(_prose(r) for _ in range(r.randint(2, 12))) + "</pre>", r.random() < 0.7
    if shape == "breaks":
        said = r.choice(["<br><br>", "<br>", "<br/>\n<br/>"]).join(_prose(r) for _ in range(r.randint(2, 9)))
        name = r.choice(["", _named(r, CONTENT), _named(r, CONTENT), _named(r, GRIDS)])
        return f"<div{name}{mark}>{head}{said}</div>", False
    if shape == "nameless":
        deep = r.randint(1, 4)
        return "<div>" * deep + f"<div{mark}>{inside}</div>" + "</div>" * deep, False
    if shape == "boxes":
        for _ in range(r.randint(1, 3)):
            blocks.insert(r.randint(0, len(blocks)), _box(r))
        return f"<div{r.choice([_named(r, CONTENT), _named(r, CONTENT), ''])}{mark}>{head}{''.join(blocks)}</div>", False
    if shape == "table":
        menu = "<br>".join(_item(r) for _ in range(r.randint(1, 6)))
        cells = [f'<td data-main="0">{menu}</td>', f"<td{mark}>{inside}</td>"] + ([f'<td data-main="0">{side}</td>'] if r.random() < 0.3 else [])
        return f"<table><tr>{''.join(cells)}</tr></table>", False
    outer = [_named(r, GRIDS) for _ in range(r.randint(1, 3))]
    column = f"<div{_named(r, GRIDS)}{mark}>{inside}</div>"
    beside = f'<div{_named(r, GRIDS)} data-main="0">{side}</div>' if r.random() < 0.7 else ""
    return "".join(f"<div{n}>" for n in outer) + r.choice([column + beside, beside + column]) + "</div>" * len(outer), False


def page(seed: int, shapes: tuple[str, ...] = SHAPES) -> str:
    """One labelled page: two in five have a named article, the others one of ``shapes``."""
    r = random.Random(seed)
    shape = "named" if "named" in shapes and r.random() < 0.4 else r.choice(shapes)
    others = list(PARTS)
    some = lambda low, high, inside=False: [_other(r, r.choice(others), inside) for _ in range(r.randint(low, high))]
    title = _sentence(r, 1, 12)
    head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>", ""])
    blocks = [_block(r) for _ in range(r.choice([0, 1, 2, 4, 8, 14, r.choice([14, 60])]))] or ([] if head and shape == "named" else [_block(r)])
    for part in some(0, 2, True) if shape == "named" and r.random() < 0.5 else []:
        blocks.insert(r.randint(0, len(blocks)), part)
    in_body = False
    if shape == "named":
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = _named(r, CONTENT) if tag in ("div", "section") or r.random() < 0.3 else ""
        main = f'<{tag}{name} data-main="1">{head}{"".join(blocks)}</{tag}>'
        if r.random() < 0.3:
            main = f'<{r.choice(["main", "div"])}{r.choice(["", _named(r, CONTENT + " container wrapper")])}>{main}{"".join(some(0, 1))}</div>'
    else:
        main, in_body = _shaped(r, shape, head, blocks, "".join(some(1, 2)))
    before, after = ("nav", "header", "advert"), ("footer",)
    start = [_other(r, {"nav": "menu"}.get(x, x), False) for x in before if r.random() < 0.6] + some(0, 1)
    rest = some(0, 3) + [_other(r, x, False) for x in after if r.random() < 0.8]
    r.shuffle(start)
    if r.random() < (0.2 if shape == "named" else 0.5):
        start, rest = [], []
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head>"
            f'<body data-main="{int(in_body)}">{r.choice(["<script>var t=1;</script>", "<!-- x -->", ""])}{"".join(start)}{main}{"".join(rest)}</body></html>')


def pages(n: int, first: int = 0, shapes: tuple[str, ...] = SHAPES) -> list[str]:
    return [page(first + i, shapes) for i in range(n)]
