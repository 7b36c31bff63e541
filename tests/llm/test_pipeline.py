import re

import corpus_pipeline
import pytest
from llm_cases import EDGES, prose

from quire.llm import registry
from test_decontaminate import expected as leaks
from test_minhash import edited
from test_minhash import expected as copies
from test_models import spoilt

sentencepiece = pytest.importorskip("sentencepiece")


def test_stages_against_brute_force(spark, docs, tmp_path):
    bench = [(k, prose(25, 9000 + k)) for k in range(5)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(k, prose(60 + k % 50, k), "en") for k in range(120)]
    rows += [(500 + k, edited(rows[k][1], k % 2, k), "en") for k in range(30)] + [(0, rows[0][1], "en")]
    rows += [(600 + k, prose(40, 700 + k) + " " + bench[k % 5][1] + " " + prose(10, k), "en") for k in range(10)]
    rows += [(700 + k, spoilt(prose(80, 800 + k), k % 4), "en") for k in range(20)] + [(i and 900 + i, t, "en") for i, t in EDGES]
    tables = [docs(rows)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        tables.append(spark.read.parquet(path))
    ids = [sorted(r["doc_id"] for r in t.where("doc_id is not null").collect()) for t in tables]
    columns = [t.columns for t in tables]
    assert columns[0] == columns[1] == columns[2] == columns[3] == columns[4]
    good = [i for i, _, _ in rows if i is not None and (i < 700)]
    assert set(good) <= set(ids[1]) and sum(i in ids[1] for i in range(700, 720)) <= 2
    assert not {901, 902, 903} & set(ids[1])
    assert ids[2] == [i for i in ids[1] if i != 904]  # without a letter
    text = {i: t for i, t, _ in rows}
    alone = copies([(i, text[i]) for i in set(ids[2])])
    assert ids[3] == sorted(i for i, (_, _, kept) in alone.items() if kept)
    assert ids[4] == [x[0] for x in sorted(leaks([(i, text[i]) for i in ids[3]], bench)) if not x[5]]
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert {r["doc_id"]: r["ids"] for r in tables[5].where("doc_id is not null").collect()} == {i: sp.encode(text[i]) for i in ids[4]}


def test_empty_documents(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = docs([])
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
    assert table.count() == 0


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE) <= set(registry.QUERIES)
