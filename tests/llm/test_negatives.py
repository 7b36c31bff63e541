"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest

from quire.llm import negatives

COLUMNS = "vec_id long, embedding array<double>, label int, id long, row long, q long, norm double, score long, anchor long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 0.5, 7, 7) for r in rows], COLUMNS)


def plain(rows):
    use = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for n, i, label, v in use:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m, other) for m, j, other, w in use if m != n)
        for p in [s for s in scored if s[4] == label][:5]:
            ps = -p[0]
            hard = [s for s in scored if s[4] != label and 50 * ps <= -100 * s[0] <= 95 * ps][:3]
            out += [(i, None if p[1] else p[2], k + 1, None if s[1] else s[2], ps, -s[0]) for k, s in enumerate(hard)]
    return sorted(out, key=repr)


def mined(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cloud(seed, n, dim, spread=0.6, centres=6):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    at = r.integers(0, centres, n)
    v = (c[at] + spread * r.normal(size=(n, dim))) * r.uniform(0.2, 1.5, n)[:, None]
    return [(i, v[i].tolist(), int(r.integers(0, 3) if r.random() < 0.5 else at[i])) for i in range(n)]


@pytest.mark.parametrize("seed, dim, block", [(1, 8, 4096), (2, 24, 4), (3, 2, 4096)])
def test_all_pairs(spark, monkeypatch, seed, dim, block):
    monkeypatch.setattr(negatives, "WINDOW", 16)
    rows = cloud(seed, 900, dim)
    found = mined(negatives.mine(frame(spark, rows), block=block))
    assert found == plain(rows)
    assert len(found) > 50


def test_ties_and_copies(spark):
    """A third of all rows are the same vector; components are coarse, so that many scores tie."""
    r = random.Random(4)
    rows = [(i, [1.0, 0.5, 0.0], i % 4) for i in range(400)]
    rows += [(400 + i, [r.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)], r.randint(0, 9)) for i in range(800)]
    rows += rows[50:52] + [(100, [0.5, 0.5, 0.5], 3), (-50, [1.0, 1.0, 1.0], 2)]
    found = mined(negatives.mine(frame(spark, rows)))
    assert found == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.7, 0.0], None), (4, None, 2), (5, [0.8, None], 2), (6, [nan, 0.0], 2), (8, [inf, 0.0], 2), (9, [0.0, 0.0], 2), (None, [0.7, 0.0], 2),
            (None, [0.9, 0.0], 1), (50, [], 1), (100, [-1.0, 0.0], 2), (150, [0.0, 0.0], 2), (10, [0.8, 0.0, 5.0], 3), (11, [-0.001, 0.75], 2), (200, [0.9, 0.2, 0.1, 0.0], 1), (7, [0.8, 0.0], 1)]
    found = mined(negatives.mine(frame(spark, rows)))
    assert found == plain(rows)
    assert found
    assert mined(negatives.mine(frame(spark, []))) == []
    assert mined(negatives.mine(frame(spark, rows[3:8]))) == []
    assert mined(negatives.mine(frame(spark, [(0, [1.0], 1)]))) == []


def test_large_components(spark):
    """Sums beyond 2^53 are still exact."""
    r = random.Random(6)
    rows = [(i * 10, [r.uniform(-1, 1) * 2**22 + r.random() for _ in range(12)], i % 3) for i in range(60)]
    assert mined(negatives.mine(frame(spark, rows))) == plain(rows)
    assert negatives.inner(np.array([[2**60, 1]]), np.array([[2**60, 1], [1, 1]])).tolist() == [[2**62, 2**60 + 1]]


def test_bounds_hold_and_filter():
    """No score lies outside its window's bounds, and in clustered data most windows are passed over."""
    rows = cloud(9, 4000, 16, spread=0.15, centres=12)
    q = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    norm = negatives.norms(q)
    refs = negatives.pick_references(q[:1000].astype(float), 16)
    angles = negatives.angles_to(refs, q, norm)
    order = np.lexsort((angles.min(1), angles.argmin(1)))
    q, norm, angles = q[order], norm[order], angles[order]
    first = np.arange(0, len(q), 32)
    a = slice(0, len(q), 97)
    w = negatives.Wanted(np.arange(len(q))[a], None, q[a], norm[a], angles[a], None, None, True, 5)
    up, down = negatives.bounds(w, np.minimum.reduceat(angles, first), np.maximum.reduceat(angles, first), np.minimum.reduceat(norm, first), np.maximum.reduceat(norm, first))
    score = negatives.inner(w.q, q)
    assert (np.maximum.reduceat(score, first, axis=1) <= up).all() and (np.minimum.reduceat(score, first, axis=1) >= down).all()
    fifth = -np.sort(-score, 1)[:, 5]
    assert (up >= fifth[:, None]).mean() < 0.5
