"""Quality classifier, language identification, page extraction."""

import random

import numpy as np
import pyarrow as pa
from llm_cases import EDGES, prose

from quire.llm import dom, extract, labelled, language, quality


def spoilt(text, kind):
    w = text.split(" ")
    if kind == 0:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 1:
        return " ".join(x + s for x, s in zip(w, ["&&&", "***", "$$$", "###"] * len(w), strict=False))
    if kind == 2:
        return " ".join(x for x in w[: len(w) // 8 + 1] for _ in range(8))
    return " | ".join(x + "quatre" for x in w)


def test_quality_without_labels(docs):
    r = random.Random(1)
    good = [(k, prose(r.randint(20, 300), k)) for k in range(400)]
    bad = [(1000 + k, spoilt(prose(r.randint(20, 300), 5000 + k), k % 4)) for k in range(80)]
    got = {x["doc_id"]: x for x in quality.classify(docs(good + bad)).collect()}
    assert sum(got[i]["kept"] for i, _ in good) >= 0.98 * len(good)
    assert sum(not got[i]["kept"] for i, _ in bad) >= 0.9 * len(bad)
    assert sum(got[i]["weak_label"] >= 0.5 for i, _ in good) >= 0.98 * len(good)
    kept = {x["doc_id"] for x in quality.keep_good(docs(good + bad)).collect()}
    assert kept == {i for i, x in got.items() if x["kept"]}


def test_estimated_accuracies():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.8
    hit = np.array([0.95, 0.9, 0.9, 0.85, 0.85, 0.97, 0.9, 0.9])
    vote = np.where(r.random((len(y), 8)) < hit, y[:, None], ~y[:, None])
    votes = np.where(r.random(vote.shape) < 0.2, 0, vote + 1)
    pattern, count = np.unique(votes @ 3 ** np.arange(8), return_counts=True)
    model = quality.estimate(quality.digits(pattern), count.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.accuracy() - hit[:, None]).max() < 0.05


def test_quality_edges(docs):
    got = [(x["doc_id"], x["score"], x["kept"]) for x in quality.classify(docs(EDGES)).collect()]
    assert len(got) == len(EDGES)
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, 0.0, False), (2, 0.0, False), (3, 0.0, False)}
    assert quality.classify(docs([])).count() == 0 and quality.keep_good(docs([])).count() == 0
    assert quality.classify(docs([(1, None)])).collect()[0]["kept"] is False


TONGUES = {"en": "the and with that from have this they were which people house water little", "de": "der und die nicht eine werden schon über zwischen können straße müssen auch",
           "fr": "les des une dans pour avec être étaient leur français garçon très même où", "es": "los las una para con qué más también niño años señor mañana está"}


def spoken(n):
    r = random.Random(n)
    return [(k, " ".join(r.choice(TONGUES[t].split()) for _ in range(r.randint(8, 60))) + "!1", t) for k, t in enumerate(r.choices(list(TONGUES), k=n))]


def test_languages_held_out(docs):
    rows = spoken(600)
    got = {x["doc_id"]: x for x in language.identify(docs(rows)).collect()}
    out = [i for i, _, _ in rows if got[i]["held_out"]]
    assert 100 < len(out) < 300
    assert all(got[i]["lang_pred"] == t and 0.5 < got[i]["score"] <= 1 for i, _, t in rows if i in out)
    wrong = [(i, s, "xx" if got[i]["held_out"] else t) for i, s, t in rows]  # held-out labels are never read
    assert sorted(map(str, language.identify(docs(wrong)).collect())) == sorted(map(str, got.values()))


def test_language_edges(docs):
    got = [(x["doc_id"], x["held_out"], x["lang_pred"], x["score"]) for x in language.identify(docs([*EDGES, *((i + 100, s, t) for i, s, t in spoken(80))])).collect() if x["doc_id"] is None or x["doc_id"] <= 4]
    assert {(i, p, s) for i, _, p, s in got if i in (1, 2, 3, 4)} == {(i, "und", 0.0) for i in (1, 2, 3, 4)}
    assert {h for i, h, _, _ in got if i is None} == {False}
    nothing = language.identify(docs(EDGES)).collect()
    assert {x["lang_pred"] for x in nothing} == {"und"} and len(nothing) == len(EDGES)
    assert language.identify(docs([])).count() == 0 and language.keep_known(docs([])).count() == 0
    assert {x["doc_id"] for x in language.keep_known(docs([(900 + i, t) for i, t in EDGES if i] + spoken(80))).collect()} >= set(range(80))


def test_presence_is_of_whole_texts():
    long = "a" * 300000 + " xyz"
    p = language.presence(pa.array([long, "xyz", None, ""]))
    assert ((p[0] >= p[1]) | (p[1] == 0)).all() and p[1].sum() >= 5 and p[2:].sum() == 0


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    levels = [np.array([0, 6]), np.array([1, 2, 7]), np.array([3, 4, 5])]
    f = extract.Forest(parent, levels, np.arange(8), np.arange(8))
    m = extract.Model(r.normal(size=extract.FEATURES), r.normal(size=(2, 2)))
    p, joint = extract.marginals(f, m)
    labels = (np.arange(256)[:, None] >> np.arange(8)) & 1
    score = labels @ m.weights[:8] + sum(m.pair[labels[:, parent[i]], labels[:, i]] for i in range(8) if parent[i] >= 0)
    weight = np.exp(score)
    assert np.allclose(p, (weight[:, None] * labels).sum(0) / weight.sum())
    assert np.allclose(joint[4, 1, 0], (weight * labels[:, 1] * (1 - labels[:, 4])).sum() / weight.sum())


def test_blocks_of_a_page():
    page = dom.read_page('<div class="Main-body">x&amp;y <p>one <b>two<br>three<p>four <a href="?a>b">five</a><ul><li>six<li>seven</ul>tail<!-- no --><script>"</p>"</script></div><p>cut off &eacute; <i')
    assert [(page.tag[n], s) for n, s in page.runs] == [("div", "x&y"), ("p", "one two three"), ("p", "four five"), ("li", "six"), ("li", "seven"), ("div", "tail"), ("p", "cut off é")]
    assert page.names[page.runs[0][0]] == ["main", "body"]
    assert dom.read_page("").runs == [] and dom.read_page("plain").runs == [(0, "plain")]


def test_held_out_pages():
    pages = [dom.read_page(h) for h in labelled.pages(200, 10**6)]
    p, _ = extract.marginals(extract.forest(pages), extract.default_model())
    y = np.array([x for q in pages for x in extract.labels(q)])
    assert ((p > 0.5) == y).mean() > 0.985


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Our site</h1><nav><a href=/>Home</a> <a href=/x>News</a></nav></header>
<div class="cookie-notice"><p>We use cookies to make this site better for you. Please accept them.</p><button>OK</button></div>
<article><h1>Big &amp; small
 news</h1><p>First <em>long</em> paragraph of the article, with some words in it, and a <a href=/y>link</a> to look at.</p><div class="ad">Buy now! Great offer for all of our readers.</div>
<p>Second&nbsp;paragraph goes on for a while, so that readers have something to read.</p><ul><li>A point made well.</li><li>Another point made.</li></ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One story</a></li><li><a href=/2>Two stories</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this article very much, thank you for it.</p></div></section>
<form><label>Mail</label><input><button>Subscribe</button></form><footer><p>&copy; 2020 Our site. All rights reserved.</p></footer></body></html>"""
TEXT = ("Big & small news\nFirst long paragraph of the article, with some words in it, and a link to look at.\nSecond paragraph goes on for a while, so that readers have something to read.\n"
        "A point made well.\nAnother point made.")


def test_extract_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<nav><a href=/>Home</a></nav>"), (4, "x", PAGE[:600])]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = [(x["page_id"], x["url"], x["text"], x["n_chars"]) for x in extract.extract(pages).collect()]
    assert got.count((1, "u", TEXT, len(TEXT))) == 2
    assert {(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)} <= set(got)
    assert [g[2] for g in got if g[0] == 4][0].startswith("Big & small news\nFirst long")
    assert extract.extract(pages.where("false")).count() == 0
