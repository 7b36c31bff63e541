"""Cases of the second round's advice."""

import base64
import random

import corpus_pipeline
import pytest
from llm_cases import prose

from quire.llm import dom, extract, language, minhash, quality
from test_minhash import edited
from test_models import TONGUES, spoilt, spoken


def test_quality_judges_unspaced_and_short_texts(docs):
    r = random.Random(1)
    rows = [(k, prose(r.randint(20, 300), k)) for k in range(400)] + [(1000 + k, spoilt(prose(r.randint(20, 300), 5000 + k), k % 4)) for k in range(80)]
    junk = ["x" * 300000, "=" * 5000, base64.b64encode(r.randbytes(30000)).decode(), "".join(r.choice("#$%&*@!") for _ in range(3000)), "Von.*** Keitkeitkeit.&&&"]
    clean = ["这是一个很长的中文句子，它没有空格。我们今天去了市场，买了一些水果和蔬菜！天气很好，孩子们在公园里玩耍，老人们在树下聊天。", "This is fine.", "Hello there, my friend.", "word"]
    rows += [(2000 + k, t) for k, t in enumerate(junk)] + [(3000 + k, t) for k, t in enumerate(clean)]
    kept = {x["doc_id"] for x in quality.keep_good(docs(rows)).collect() if x["doc_id"] >= 2000}
    assert kept == {3000 + k for k in range(len(clean))}


FOREIGN = ["Это документ на русском языке, который никто не учил, и он довольно длинный.", "αυτό είναι ένα κείμενο στα ελληνικά που κανείς δεν έμαθε ποτέ",
           "to jest tekst w języku polskim którego nikt się nie uczył i jest dość długi", "这是一个中文文本，没有人学习过它。" * 5, "x" * 3000]


@pytest.mark.parametrize("tongues", [4, 2, 1])
def test_texts_of_unlearned_languages_go(docs, tongues):
    some = [x for x in spoken(600) if x[2] in list(TONGUES)[:tongues]]
    short = [(5000, "the people", None), (5001, "that house", None), (5002, "with water", None)]
    noise = random.Random(2)
    junk = [*FOREIGN, "".join(noise.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400))]
    kept = {x["doc_id"] for x in language.keep_known(docs(some + short + [(9000 + k, t) for k, t in enumerate(junk)])).collect()}
    assert kept == {x[0] for x in some + short}


def test_null_and_repeated_ids_take_part(spark, docs, tmp_path):
    bench = [(0, prose(25, 9000))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b, c, d, e, leak = prose(200, 1), prose(200, 2), prose(200, 3), prose(200, 4), prose(200, 5), prose(40, 6) + " " + bench[0][1] + " " + prose(10, 7)
    rows = [(None, a), (None, a), (None, a), (None, edited(a, 1, 1)), (None, b), (5, b), (7, c), (7, d), (7, c), (8, edited(d, 1, 2)), (9, leak), (None, leak + " x"), (9, e)]
    found = sorted((str(x["component_id"]), x["kept"]) for x in minhash.near_duplicates(docs(rows)).collect())
    assert found == sorted([("None", True)] + 3 * [("None", False)] + [("5", True), ("5", False)] + [("7", True)] * 2 + [("7", False)] * 2 + [("9", True)] * 2 + [("9", False)])
    left = corpus_pipeline.near_dedup(spark, docs(rows), str(tmp_path))
    got = [(x["doc_id"], x["text"]) for x in left.collect()]
    assert len(got) == 6 and {(5, b), (7, c), (7, d), (9, leak), (9, e)} <= set(got) and {i for i, _ in got} == {None, 5, 7, 9}
    clean = corpus_pipeline.clean_of_benchmarks(spark, docs(rows), str(tmp_path))
    assert sorted(x["text"] for x in clean.collect()) == sorted(t for _, t in rows if not t.startswith(leak))


FIRST, LAST = "First paragraph of the article, with some words in it to read.", "Second paragraph goes on for a while, so that readers have something."


@pytest.mark.parametrize("between", ["<svg class='icon'/>", "<math/>", "<p><svg viewBox='0 0 1 1'><path d='M0 0'/></svg></p>", "<svg><path d='M0'>", "<object data=x>", "<canvas>", "<select>", "<template>", "<noscript>"])
def test_what_stands_between_paragraphs_loses_none(between):
    page = dom.read_page(f"<html><body><article><h1>Big news</h1><p>{FIRST}</p>{between}<p>{LAST}</p></article></body></html>")
    assert extract.main_texts([page], extract.default_model()) == [f"Big news\n{FIRST}\n{LAST}"]


def test_formulas_and_fallbacks_are_text():
    page = dom.read_page("<article><h1>Big news</h1><p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is <span class=x>one</span> <em id=y>long</em> <b class='title'>line</b> of words.</p>"
                         f"<noscript><p>{FIRST}</p></noscript><object><p>{LAST}</p></object><canvas><p>{FIRST}</p></canvas><script>var x = '<p>no</p>'</script></article>")
    assert extract.main_texts([page], extract.default_model()) == [f"Big news\nThe sum x+y is one long line of words.\n{FIRST}\n{LAST}\n{FIRST}"]


def test_named_spans_of_boilerplate_stay_apart():
    page = dom.read_page(f"<article><p>{FIRST} <span class='advert'>Buy now!</span></p><span class='share tools'>Share this</span><p>{LAST}</p></article>")
    assert [said for _, said in page.runs] == [FIRST, "Buy now!", "Share this", LAST]
