import random

from pyspark.sql import functions as F

from quire.functions import fixed
from quire.operators import articles
from quire.operators.articles import blocks_of, extract

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _random_doc(rng: random.Random) -> str:
    lines = []
    for _ in range(rng.randint(0, 25)):
        r = rng.random()
        if r < 0.25:
            lines.append("#" * rng.randint(1, 4) + " " + " ".join(rng.choices(WORDS, k=rng.randint(1, 3))))
        elif r < 0.35:
            lines.append("")
        elif r < 0.40:
            lines.append("- " + rng.choice(WORDS))
        elif r < 0.45:
            lines.append("| " + rng.choice(WORDS) + " |")
        elif r < 0.48:
            lines.append("```")
        else:
            lines.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 40))))
    return "\n".join(lines)


def test_blocks_golden():
    t = ("intro\n\n# A\npara\n## B\n- item\n## inside list\n\nb text\n```\ncode\n## not a heading\n```\n"
         "### C\n| x |\n| y |\nafter\n## D\n```\nunclosed")
    got = [(b[1], b[2], b[3], b[5], b[6], b[7], b[8], b[9]) for b in blocks_of(t)]
    assert got == [
        (0, "para", 0, "intro", False, 0, 0, []),
        (2, "heading", 1, "# A", False, 1, None, []),
        (3, "para", 1, "para", False, 1, 0, [1]),
        (4, "heading", 2, "## B", True, 2, None, [1]),
        (5, "para", 2, "- item\n## inside list", True, 2, 0, [1, 2]),
        (8, "para", 2, "b text", True, 2, 1, [1, 2]),
        (9, "para", 2, "```\ncode\n## not a heading\n```", True, 2, 2, [1, 2]),
        (13, "heading", 3, "### C", False, 3, None, [1, 2]),
        (14, "para", 3, "| x |\n| y |", False, 3, 0, [1, 2, 3]),
        (16, "para", 3, "after", False, 3, 1, [1, 2, 3]),
        (17, "heading", 2, "## D", False, 4, None, [1]),
        (18, "para", 2, "```\nunclosed", False, 4, 0, [1, 4]),
    ]


def test_no_text_and_blank_lines():
    assert blocks_of("") == []
    assert blocks_of("   \n\t\n") == []


HINT = "\n\nIf you want to read more, please use the `search_articles` tool with `length='{}'` to get a more detailed article.\n"
SCHEMA = "page_id long, language_code string, text_body string"


def _texts(spark, docs, length):
    df = spark.createDataFrame(docs, SCHEMA)
    targets = df.select("language_code", "page_id", F.lit(length).alias("length"))
    return {r.page_id: r.article_text for r in extract(df, targets).collect()}


def _w(n, word="w"):
    return " ".join([word] * n)


def test_cuts_worked_by_hand(spark):
    """Budgets: very-short 50 words (100 CJK characters), short 150 (300)."""
    cases = [  # (language, text, length, expected)
        ("en", "", "short", ""),
        ("en", _w(150), "short", _w(150)),                                    # exact fit
        ("en", _w(151), "short", _w(151)),                                    # the first paragraph always stays
        ("en", f"{_w(100)}\n\n{_w(51)}", "short", _w(100) + HINT.format("medium")),
        # one that does not fit ends the text, a smaller one after it does not come in
        ("en", f"{_w(100)}\n\n{_w(60)}\n\nsmall", "short", _w(100) + HINT.format("medium")),
        # the headings above a paragraph are paid once (2 + 2 words): 2 + 2 + 70 + 76 = 150
        ("en", f"# T\n\n## A\n\n{_w(70)}\n\n{_w(76)}", "short", f"# T\n\n## A\n\n{_w(70)}\n\n{_w(76)}"),
        ("en", f"# T\n\n## A\n\n{_w(70)}\n\n{_w(77)}", "short", f"# T\n\n## A\n\n{_w(70)}" + HINT.format("medium")),
        # the first level-2 heading first, then the others one paragraph in turn
        ("en", f"## A\n\na1\n\na2\n\n## B\n\n{_w(100)}\n\n{_w(60)}\n\n## C\n\nc1",  "short",
         f"## A\n\na1\n\na2\n\n## B\n\n{_w(100)}\n\n## C\n\nc1" + HINT.format("medium")),
        # omitted headings, indented by level
        ("en", f"{_w(150)}\n\n## A\n\nx\n\n### B\n\ny", "short",
         _w(150) + "\n\n## Omitted Headings\n- A\n  - B" + HINT.format("medium")),
        ("en", f"{_w(1500)}\n\n## A\n\nx", "medium", _w(1500) + "\n\n## Omitted Headings\n- A" + HINT.format("full")),
        ("en", f"# T\n\n{_w(40)}\n\n{_w(30)}", "very-short", f"T\n\n{_w(40)}"),
        ("en", "# T\n\n" + _w(5000), "full", "# T\n\n" + _w(5000)),
        # a list, a table and a fence are one block each
        ("en", f"- a\n- b\n\n| x | y |\n| 1 | 2 |\n\n```\n# no heading\n```\n{_w(200)}", "short",
         "- a\n- b\n\n| x | y |\n| 1 | 2 |\n\n```\n# no heading\n```" + HINT.format("medium")),
        # CJK text counts characters
        ("ja", "あ" * 300, "short", "あ" * 300),
        ("ja", "あ" * 200 + "\n\n" + "い" * 101, "short", "あ" * 200 + HINT.format("medium")),
        ("zh", "## 一\n\n" + "中" * 96 + "\n\n国", "very-short", "一\n\n" + "中" * 96),
    ]
    for length in ("very-short", "short", "medium", "full"):
        docs = [(i, lang, text) for i, (lang, text, n, _) in enumerate(cases) if n == length]
        got = _texts(spark, docs, length)
        for i, _, text in docs:
            assert got[i] == cases[i][3], (length, text[:80])


def test_cut_invariants_on_random_documents(spark):
    rng = random.Random(7)
    docs = [(i, "en" if i % 3 else "ja", _random_doc(rng)) for i in range(200)]
    df = spark.createDataFrame(docs, SCHEMA)
    for length in ("very-short", "short"):
        targets = df.select("language_code", "page_id", F.lit(length).alias("length"))
        _, rows = articles._selection(articles.target_blocks(df, targets), targets)
        cut = {}
        for r in rows.collect():
            cut.setdefault(r.page_id, []).append(r)
        for i, lang, text in docs:
            own = cut.get(i, [])
            paras = sorted((r for r in own if r.kind == "para"), key=lambda r: r.priority)
            kept = [r for r in paras if r.keep]
            assert [r.priority for r in paras] == list(range(1, len(paras) + 1))
            assert [r.priority for r in kept] == list(range(1, len(kept) + 1)) and (kept or not paras)
            blocks = blocks_of(text)
            heads = {b[7]: b[5] for b in blocks if b[2] == "heading"}
            above = {b[1]: b[9] for b in blocks if b[2] == "para"}
            size = len if lang == "ja" else (lambda t: len(t.split()))
            required = {r.heading_no for r in own if r.kind == "heading" and r.required}
            assert required == {h for r in kept for h in above[r.line_start]}
            total = sum(size(r.content) for r in kept) + sum(size(heads[h]) for h in required)
            limit = fixed.LENGTH_LIMITS[length][lang == "ja"]
            assert total <= limit or len(kept) == 1
            if len(kept) < len(paras):  # the next one would not have fitted
                nxt = paras[len(kept)]
                more = {h for h in above[nxt.line_start]} - required
                assert total + size(nxt.content) + sum(size(heads[h]) for h in more) > limit
            omitted = [r for r in own if r.kind == "heading" and not r.required and r.level >= 2]
            assert len(omitted) == sum(len(b[5]) - len(b[5].lstrip("#")) >= 2 for b in blocks if b[2] == "heading") - sum(
                b[3] >= 2 for b in blocks if b[2] == "heading" and b[7] in required)
