import numpy as np

from quire.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, id long, class long, a long, unit string, weight long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, 1, 1, "u", 1) for i, v, k in rows], SCHEMA)


def expected(rows):
    up = {i: i for i, _, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(up, 0)
    for k, (i, v, p) in enumerate(rows):
        for j, w, q in rows[k + 1:]:
            x, y = np.float32(v).astype(float), np.float32(w).astype(float)
            if p == q and p is not None and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[i] += 1
                n[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (n[i], top(i), top(i) == i) for i in up}


def at_cosine(rng, x, cosine):
    z = rng.normal(size=len(x))
    z -= z @ x * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def unit(rng, dim=64):
    x = rng.normal(size=dim)
    return x / np.linalg.norm(x)


def test_nearest_point_of_e8():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(200, 8)) * 2
    found = lattice.nearest_e8(y)
    near = found[:, None] + np.concatenate([lattice._neighbours(), np.zeros((1, 8))])
    assert (((y - found) ** 2).sum(1) <= ((y[:, None] - near) ** 2).sum(2).min(1) + 1e-9).all()
    twice = 2 * found
    assert (twice == np.rint(twice)).all() and (found.sum(1) % 2 == 0).all()
    assert len(np.unique(lattice._neighbours(), axis=0)) == 240


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(3)
    x = np.stack([unit(rng) for _ in range(3000)])
    y = np.stack([at_cosine(rng, v, 0.931) for v in x])
    k = np.zeros(len(x), int)
    a, b = lattice.cells(x, k), lattice.cells(y, k)
    met = (a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))
    assert met.mean() > 0.9995


def test_groups_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for g in range(12):
        base = unit(rng)
        for c in rng.uniform(0.9, 0.999, 12):
            rows.append((i * 7 % 1009, at_cosine(rng, base, c), g % 3))
            i += 1
        rows += [((i + k) * 7 % 1009, rows[-1][1], g % 3) for k in range(3)]
        i += 3
    rows += [((i + k) * 7 % 1009, unit(rng), None if k == 0 else k % 3) for k in range(30)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(table(spark, rows)).collect()}
    assert got == expected(rows)


def test_edges(spark):
    v = [1.0] * 8
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 8, 0), (8, [1.0] * 7 + [None], 0), (9, [1.0] * 7 + [float("nan")], 0),
            (10, [1.0] * 7 + [float("inf")], 0), (None, v, 0), (11, [2.0] * 8, 0), (12, [1.0] * 4, 0), (2, v, 0), (13, [-1.0] * 8, 0)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(table(spark, rows)).collect()), key=str)
    linked = {1: (4, 1, True), 2: (4, 1, False), 11: (4, 1, False), None: (4, 1, False)}
    want = sorted([(i, *linked.get(i, (0, i, i is not None))) for i, _, _ in rows], key=str)
    assert got == want
    assert lattice.near_vectors(table(spark, [])).count() == 0


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = unit(rng)
    rows = [(i, at_cosine(rng, base, 0.97), 0) for i in range(100)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(table(spark, rows)).collect()}
    assert got == expected(rows)


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], None)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_repeated_and_null_ids(spark):
    """Each row is a vector of its own, whatever its id."""
    rng = np.random.default_rng(11)
    base = [unit(rng, 16) for _ in range(6)]
    rows = [(i % 25 if i % 5 else None, base[i % 6] if i % 4 == 0 else at_cosine(rng, base[i % 6], 0.96), i % 2 if i % 7 else None) for i in range(160)]
    rows += [(900, base[0], 0), (900, -base[0], 0), (901, at_cosine(rng, base[0], 0.95), 0)]
    plain = expected([(n, v, k) for n, (_, v, k) in enumerate(rows)])
    ids = {}
    for n, (_, top, _) in plain.items():
        ids.setdefault(top, []).append(rows[n][0])
    want = []
    for n, (i, _, _) in enumerate(rows):
        links, top, _ = plain[n]
        name = min((x for x in ids[top] if x is not None), default=None)
        want.append((i, links, name, i is not None and i == name))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
