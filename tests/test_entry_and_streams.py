import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs_on_sf0001(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["request_id", "status", "response"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == 4 * docs  # one answer per request, four requests per document
    assert {r.status for r in rows} <= {"exact_title", "exact_redirect", "hits", "not_found", "invalid", "error"}


def test_registry_and_oracles_line_up():
    from quire.plans import registry
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(registry.QUERIES) <= set(q)
    assert len(registry.QUERIES) >= 30
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_works_without_the_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    repo = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(repo, "quire"), tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
                          cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    from quire.plans import registry
    assert said.stdout.split() == [str(len(registry.QUERIES)), "False"], said.stderr


def test_resume_stream_loads_each_document_once(spark):
    df = E.queries()["resume_load_stream"](spark, SF)
    n = df.count()
    assert n == df.select("page_id", "language_code").distinct().count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()


def test_first_wins_keeps_first_copy(spark):
    from quire.plans.load import first_wins
    new = spark.createDataFrame([(1, "en", "a", 0), (1, "en", "b", 1), (2, "en", "c", 0), (3, "en", "d", 0)],
                                "page_id long, language_code string, t string, o int")
    stored = spark.createDataFrame([(3, "en")], "page_id long, language_code string")
    got = sorted((r.page_id, r.t) for r in first_wins(new, stored, ["page_id", "language_code"], "o").collect())
    assert got == [(1, "a"), (2, "c")]


def test_replayed_request_batch_replaces_itself(spark, tmp_path):
    from quire.operators.corpus import Corpus
    from quire.streaming.requests import search_stream
    docs = spark.createDataFrame([(1, "en", "One", "text one"), (2, "en", "Two", "text two")],
                                 "page_id long, language_code string, title string, text_body string")
    pages = spark.createDataFrame([], "page_id long, page_namespace int, page_title string, language_code string")
    red = spark.createDataFrame([], "from_page_id long, to_title string, language_code string")
    corpus = Corpus(documents=docs, pages=pages, redirections=red, languages=["en"]).materialize()
    spark.createDataFrame([(1, "One"), (2, "nothing")], "request_id long, title string").write.parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second run replays the first epoch
        reqs = spark.readStream.schema("request_id long, title string").parquet(str(tmp_path / "in"))
        search_stream(spark, reqs, corpus, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    got = sorted((r.request_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "exact_title"), (2, "not_found")]


def test_a_stream_leaves_only_its_answers(spark, tmp_path):
    """What the batches wrote on the way is gone; the corpus's indexes stay."""
    import os
    from quire.operators.corpus import Corpus
    from quire.session import shared_dir
    from quire.streaming.requests import search_stream
    docs = spark.createDataFrame([(1, "en", "One", "text one"), (2, "en", "Two", "text two")],
                                 "page_id long, language_code string, title string, text_body string")
    pages = spark.createDataFrame([], "page_id long, page_namespace int, page_title string, language_code string")
    red = spark.createDataFrame([], "from_page_id long, to_title string, language_code string")
    corpus = Corpus(documents=docs, pages=pages, redirections=red, languages=["en"]).materialize()
    base = os.path.dirname(shared_dir(spark, "probe")).removeprefix("file:")
    before = set(os.listdir(base))
    spark.createDataFrame([(1, "One"), (2, "text")], "request_id long, title string").write.parquet(str(tmp_path / "in"))
    reqs = spark.readStream.schema("request_id long, title string").parquet(str(tmp_path / "in"))
    search_stream(spark, reqs, corpus, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert set(os.listdir(base)) == before
    assert {r.request_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "exact_title", 2: "hits"}
    assert corpus.blocks.count()


def test_shared_folder_rules(spark, tmp_path, monkeypatch):
    import pytest

    from quire import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(), "x")
    monkeypatch.setattr(session, "_handed_out", [])
    made = session.materialize(spark.range(3), "three")
    folder = session._handed_out[-1]
    assert made.count() == 3
    import os
    assert os.path.isdir(folder.removeprefix("file:"))
    session.release_shared(spark)
    assert not os.path.exists(folder.removeprefix("file:"))
