import numpy as np
import pytest
from llm_cases import EDGES, prose

from quire.llm import tokencount as tc

BLOCKS = "file long, block long, data binary"


def counted(spark, files, size, span):
    rows = []
    for f, ids in files.items():
        data = np.array(ids, "<u2").tobytes()
        rows += [(f, k, bytearray(data[i:i + 2 * size])) for k, i in enumerate(range(0, len(data), 2 * size))]
    got = tc.scan_counts(spark.createDataFrame(rows, BLOCKS), end=0, span=span).collect()
    return sorted((r["file"], r["ordinal"], r["n_tokens"], r["closed"]) for r in got)


def expected(files):
    out = []
    for f, ids in files.items():
        n = k = 0
        for x in ids:
            if x == 0:
                out.append((f, k, n, True))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            out.append((f, k, n, False))
    return sorted(out)


@pytest.mark.parametrize("size, span", [(1, 2), (3, 1), (7, 4), (1000, 1024)])
def test_blocks_stitched(spark, size, span):
    r = np.random.default_rng(size)
    files = {0: [0, 0, 5, 5, 0, 0], 1: [1] * 40 + [0], 2: [1] * 41, 3: [0], 4: [2]}
    files |= {10 + k: (r.integers(1, 9, 150) * (r.random(150) > p)).tolist() for k, p in enumerate((0.0, 0.02, 0.3, 0.9))}
    assert counted(spark, files, size, span) == expected(files)


def test_documents(docs):
    rows = [(100 + k, prose(k, k)) for k in range(40)] + EDGES
    encode = tc._encoder(tc.VOCABULARY).encode_ordinary
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tc.count_tokens(docs(rows)).collect()), key=str)
    assert got == sorted(((i, len(encode(t or ""))) for i, t in rows), key=str)
    assert tc.count_tokens(docs([])).count() == 0
