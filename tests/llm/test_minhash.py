import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import minhash, words
from quire.llm.tables import components

from llm_cases import EDGES, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows, percent=85):
    """By comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_word_and_shingle_hashes():
    texts = ["One two  three\tfour five six", "one TWO three four five six", "", None, "a b", "ä" * 3 + " b c d e", "x" * 400000 + " y"]
    h, first = words.words(pa.array(texts), words.NOT_SPACE)
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert (h[:6] == h[6:12]).all() and len(set(h.tolist())) == 6 + 2 + 5 + 2 - 1  # `b` twice
    s, text = words.shingles(h, first, 5)
    assert np.bincount(text, minlength=7).tolist() == [2, 2, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("base_words, edits", [(400, 3), (120, 2), (60, 1), (200, 12)])
def test_groups_of_copies_against_all_pairs(spark, docs, base_words, edits):
    rows = []
    for g in range(6):
        base = prose(base_words, 100 + g)
        rows += [(1000 * g + i, edited(base, 0 if i % 4 == 0 else edits, 31 * g + i)) for i in range(14)]
    rows += [(90000 + i, prose(30, 500 + i)) for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == expected(rows)


def test_chain_links_and_far_ends(spark, docs):
    base = [f"w{i}" for i in range(400)]
    rows = [(10 - k, " ".join([f"new{j}" for j in range(12 * k)] + base[12 * k:])) for k in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: c for i, (_, c, _) in expected(rows).items()}
    assert set(got.values()) == {3}


def test_edges(spark, docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(EDGES)).collect()), key=str)
    assert len(got) == len(EDGES)
    by = {g[0]: g for g in got}
    assert by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True)
    assert by[6][2:] == (6, True) and by[7][2:] == (6, False)
    assert by[9][2:] == (9, True) and by[None][2:] == (None, True)
    assert minhash.near_duplicates(docs([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 160), (1, 2), (2, 1), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(100, 161), 5], 5), 1: 1, 2: 1}


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 700, dtype=np.uint64), rng.integers(0, 2**63, (2, 150), dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, o])) for o in own]
    sig = minhash.signatures(np.concatenate(sets), np.array([0, 850, 1700]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.06


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies_of_a_large_group_meet_in_proportion(spark, docs, monkeypatch, seed):
    """Variants of one text, two edits each, hardly any of them linked: what is
    compared must grow with the group, whatever row is the first."""
    made = []
    against, meetings, confirmed = minhash._against_hubs, minhash._meetings, minhash._confirmed
    monkeypatch.setattr(minhash, "_against_hubs", lambda stars, *a: (made.append(stars.count()), against(stars, *a))[1])
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *a: (made.append(pairs.count()), confirmed(pairs, *a))[1])

    def counted(*a):
        found = meetings(*a)
        made.append(found.count())
        return found

    monkeypatch.setattr(minhash, "_meetings", counted)
    base, totals = prose(130, 77), []
    for n in (400, 800, 1600):
        rows = [(i, edited(base, 2, 1000 + i)) for i in range(n)]
        random.Random(seed).shuffle(rows)
        rows = [(i, t) for i, (_, t) in enumerate(rows)]
        made.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows)).collect()}
        if n == 400:
            assert got == expected(rows)
        totals.append(sum(made))
    assert totals[1] <= 2.5 * totals[0] and totals[2] <= 2.5 * totals[1], totals


def test_blocks_of_members(spark, docs, monkeypatch):
    """Small blocks give the same groups."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = prose(130, 78)
    rows = [(i, edited(base, 2 + i % 3, 5000 + i)) for i in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == expected(rows)
