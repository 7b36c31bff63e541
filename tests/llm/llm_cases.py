"""Rows that the tests of the training-data operators share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, class long, a long, b long, h long, n long, score double, kept boolean"


def documents(spark, rows):
    """rows: (doc_id, text[, lang]); other columns clash with names used inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 7, 7, 7, 7, 7, 7, 0.5, False) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(n, seed=0, words=tuple("the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their".split())):
    import random

    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randint(4, 12)
        said = [r.choice(words) if r.random() < 0.6 else "".join(r.choice("abcdeilmnoprstu") for _ in range(r.randint(4, 9))) for _ in range(k)]
        out += [said[0].capitalize(), *said[1:-1], said[-1] + "."]
    return " ".join(out[:n])


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ... ***"), (None, "a null id with words of its own"), (5, "word"), (6, prose(60, 1)), (7, prose(60, 1)),
         (8, prose(20000, 2)), (9, "日本語のテキスト 😀 ünïcödé ▁ x\x00y"), (9, "日本語のテキスト 😀 ünïcödé ▁ x\x00y"), (10, "x" * 300000)]
