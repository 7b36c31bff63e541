import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from llm_cases import EDGES, prose

from quire.llm import decontaminate, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, size=10):
    grams = {}
    for item, text in items:
        w = tokens(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            grams.setdefault(tuple(w[k:k + size]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    found |= grams[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, terms long, item string")


def found(docs, spark, rows, bench, **more):
    got = decontaminate.digest(decontaminate.decontaminate(docs(rows), items(spark, bench), **more))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()), key=str)


def test_against_every_window(spark, docs, monkeypatch):
    r = random.Random(2)
    bench = [(k, prose(r.choice([3, 9, 10, 11, 40]), 70 + k)) for k in range(25)] + [(99, None), (98, "..."), (97, ""), (None, prose(14, 400)), (3, prose(12, 500))]
    rows = []
    for k in range(60):
        parts = [prose(r.randint(0, 80), 200 + k)]
        for _ in range(r.randint(0, 2)):
            said = r.choice(bench)[1] or ""
            parts += [said if r.random() < 0.6 else " ".join(said.split(" ")[: r.randint(1, 30)]), prose(r.randint(0, 30), 900 + k)]
        rows.append((k, r.choice(["\n", " ", " -- "]).join(parts).upper() if k % 5 == 0 else " ".join(parts)))
    rows += EDGES + [(500, bench[4][1]), (500, bench[4][1])]
    monkeypatch.setattr(words, "CHUNK_BYTES", 1 << 12)
    assert found(docs, spark, rows, bench) == expected(rows, bench)
    assert found(docs, spark, rows, bench[:20], slack=0) == expected(rows, bench[:20])


def test_blocks_of_windows(spark, docs):
    bench = [(k, prose(20, 70 + k)) for k in range(6)]
    rows = [(k, prose(30, k) + " " + bench[k % 6][1] + " " + bench[(k + 1) % 6][1]) for k in range(12)]
    index = decontaminate.build_index(docs(rows))
    got = decontaminate.digest(decontaminate.search(index, decontaminate.windows(items(spark, bench)), block=7))
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()), key=str) == expected(rows, bench)


def test_proximity(spark, docs):
    said = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"xx {said} yy"), (2, "xx alpha beta delta gamma epsilon zeta theta eta iota kappa"), (3, "alpha beta gamma delta epsilon new zeta eta theta iota kappa"),
            (4, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, said.replace("zeta", "q q q q q q q zeta"))]
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontaminate.decontaminate(docs(rows), items(spark, [(7, said)])).collect()}
    assert got == {1: (["7"], []), 2: ([], ["7"]), 3: ([], ["7"]), 4: ([], []), 5: ([], [])}


def test_empty_tables(spark, docs):
    assert found(docs, spark, [], [(1, "a b")]) == []
    assert found(docs, spark, EDGES, []) == expected(EDGES, [])


def test_postings_of_terms_that_differ_in_low_bits_only():
    h = np.array([8, 9, 8, 1 << 40, 9], np.uint64)
    terms, counts, order = decontaminate.postings(h)
    assert terms.tolist() == [8, 9, 1 << 40] and counts.tolist() == [2, 2, 1] and order.tolist() == [0, 2, 1, 4, 3]
    assert pa.array(terms).null_count == 0
