"""Main text of ordinary layouts, and of shapes that the model has not seen."""

import re

import pytest

from quire.llm import extract, labelled

SAID = "An ordinary paragraph of the article, long enough to be read as prose by anyone who looks at it."
MORE = "A second paragraph, which says something else and goes on for a little while before it ends."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul>'
LAYOUTS = {
    "body": (f"<html><body><h1>The title here</h1><p>{SAID}</p><p>{MORE}</p></body></html>", f"The title here\n{SAID}\n{MORE}"),
    "grid": (f'<div class="container"><div class="row"><div class="col-8"><h1>The title here</h1><p>{SAID}</p><p>{MORE}</p></div><div class="col-4">{MENU}</div></div></div>', f"The title here\n{SAID}\n{MORE}"),
    "note": (f'<body><div id="content"><p>{SAID}</p><div class="note"><p>{MORE}</p></div></div></body>', f"{SAID}\n{MORE}"),
    "nameless": (f"<body><div><div><div><h1>The title here</h1><p>{SAID}</p><p>{MORE}</p></div></div></div></body>", f"The title here\n{SAID}\n{MORE}"),
    "pre": (f"<body><pre>{SAID}\n{MORE}</pre></body>", f"{SAID} {MORE}"),
    "table": (f'<table><tr><td><a href="/">Home</a></td><td><h1>The title here</h1><p>{SAID}</p></td></tr></table>', f"The title here\n{SAID}"),
}


def texts(htmls, model=None):
    return extract.main_texts([extract.read_page(h) for h in htmls], model or extract.default_model())


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    html, want = LAYOUTS[layout]
    assert texts([html]) == [want]


def test_line_breaks_in_a_block():
    """A break is white space within the block or its end, as the reader has it; no word is lost."""
    [found] = texts([f'<html><body><div class="post">{SAID}<br><br>{MORE}</div></body></html>'])
    assert found.split() == f"{SAID} {MORE}".split()


@pytest.mark.parametrize("shape", ["grid", "boxes"])
def test_shapes_held_out(shape):
    model = extract.train(labelled.pages(500, shapes=tuple(s for s in labelled.SHAPES if s != shape)))
    marked = [labelled.page(10**6 + i, (shape,)) for i in range(60)]
    pages = [extract.read_page(h) for h in marked]
    want = ["\n".join(said for node, said in p.runs if extract.labels(p)[node]) for p in pages]
    found = texts([re.sub(r' data-main="."', "", h) for h in marked], model)
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 45
