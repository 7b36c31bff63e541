import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from quire.llm import pieces

from llm_cases import EDGES

sentencepiece = pytest.importorskip("sentencepiece")
SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def spans(ids, first):
    return [ids[i:j].tolist() for i, j in zip(first[:-1], first[1:], strict=True)]


def test_ids_equal_the_library(model, library):
    r = random.Random(4)
    texts = ["", " ", "  a", "a  ", "a" * 500 + " " * 400 + "ab" * 300, "日本語 テキスト😀 𝔘\x00", "<s> </s> <0x41> <unk>", "x▁y", "ff fi ﬁ ①"]
    texts += ["".join(r.choice("aehinorst  \n.,é1") for _ in range(r.randint(1, 60))) for _ in range(400)]
    if os.path.exists(SF001):
        texts += pq.read_table(f"{SF001}/documents.parquet")["text"].to_pylist()
    assert spans(*pieces.encode(model, texts)) == [library.encode(t) for t in texts]


def test_long_words(model, library):
    r = random.Random(8)
    texts = ["".join(r.choice("ABCdefGHI0123456789+/étheing日") for _ in range(n)) for n in (201, 5000, 300000)] + ["x" * 300000, " " * 5000 + "y"]
    assert spans(*pieces.encode(model, texts)) == [library.encode(t) for t in texts]


def test_round_trip_and_library_decoding(model, library):
    texts = ["", " x", "a  b\n\tc ", "日本語😀", "x▁y"]
    ids, first = pieces.encode(model, texts)
    assert pieces.decode(model, ids, first) == [t.replace("▁", " ") for t in texts]
    assert pieces.decode(model, np.array([model.byte[0xE6], model.byte[0x97]]), np.array([0, 2])) == ["�"]


def test_forgetting_keeps_results(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 8)
    texts = ["one two three four five", "six seven eight nine ten eleven twelve", "one six two seven"]
    for t in texts * 2:
        assert spans(*pieces.encode(model, [t])) == [library.encode(t)]


def test_unigram_scores_are_maximised(model):
    import copy

    m = copy.copy(model)
    m.bpe, m.score = False, -np.log(np.arange(len(model.score)) + 2.0)
    for word in ("▁international", "▁the", "▁xqzt"):
        letters = np.array([[ord(c) for c in word]], np.uint32)
        found, n = pieces.viterbi(m, letters)
        known = {m.strings[i].decode().replace(" ", "▁"): m.score[i] for i in m.ids}

        def best(at, word=word, known=known):
            if at == len(word):
                return 0.0
            return max(known.get(word[at:end], m.score.min() - 10 if end == at + 1 else -np.inf) + best(end) for end in range(at + 1, min(len(word), at + 16) + 1))

        got = sum(m.score[t] if t >= 0 else m.score.min() - 10 for t in found[0, len(word) - n[0]:])
        assert abs(got - best(0)) < 1e-9


def test_tables(spark, docs, library):
    got = pieces.encode_documents(docs(EDGES))
    rows = {(r["doc_id"], r["round_trip"]): r for r in got.collect()}
    assert sum(1 for _ in got.collect()) == len(EDGES)
    assert rows[1, None]["ids"] is None and rows[1, None]["n_tokens"] is None
    assert rows[2, True]["ids"] == [] and rows[9, False]["n_tokens"] == len(library.encode(EDGES[9][1]))
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(got).collect()}
    assert all(back[i] == (t.replace("▁", " ") if t else t) for i, t in EDGES)
    assert pieces.encode_documents(docs([])).count() == 0
