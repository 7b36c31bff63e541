import gzip

from quire.sources.dumps import read_page_dump, read_redirect_dump


def _write(tmp_path, name, lines):
    p = tmp_path / name
    with gzip.open(p, "wb") as f:
        f.write("\n".join(lines).encode("utf-8") + b"\n")
    return str(p)


def test_page_dump_scan(spark, tmp_path):
    lines = [
        "-- MySQL dump",
        "/*!40000 ALTER TABLE `page` DISABLE KEYS */;",
        "INSERT INTO `page` VALUES (1,0,'Rock_\\'n\\'_Roll',0,0),(2,0,'It''s',0,0),(3,1,'Talk_page',0,0),(4,0,'',0,0);",
        "INSERT INTO `redirect` VALUES (9,0,'Not_a_page','',''),(10,0,'X','','');",
        "INSERT INTO `page` VALUES (5,0,'Caf\xe9',1,0);",
        "/*!40000 ALTER TABLE `page` ENABLE KEYS */;",
    ]
    path = _write(tmp_path, "xx-page.sql.gz", lines)
    got = sorted((r.page_id, r.page_title) for r in read_page_dump(spark, path, "xx").collect())
    assert got == [(1, "Rock_'n'_Roll"), (2, "It's"), (4, ""), (5, "Café")]
    ref = sorted((r.page_id, r.page_title) for r in read_page_dump(spark, path, "xx", escapes="reference").collect())
    assert ref[0] == (1, "Rock_\\")


def test_redirect_dump_scan_keeps_all_namespaces(spark, tmp_path):
    lines = ["INSERT INTO `redirect` VALUES (7,0,'Target','',''),(8,14,'Category_thing','','');"]
    path = _write(tmp_path, "xx-redirect.sql.gz", lines)
    got = sorted((r.from_page_id, r.to_title) for r in read_redirect_dump(spark, path, "xx").collect())
    assert got == [(7, "Target"), (8, "Category_thing")]


def test_first_copy_of_a_dump_wins(spark, tmp_path):
    from quire.plans.load import load_dataset
    lines = ["INSERT INTO `page` VALUES " + ",".join(f"({i},0,'First_{i}',0)" for i in range(k, k + 20)) + ";" for k in range(0, 200, 20)]
    again = ["INSERT INTO `page` VALUES " + ",".join(f"({i},0,'Second_{i}',0),({i},0,'Third_{i}',0)" for i in range(200)) + ";"]
    src = read_page_dump(spark, _write(tmp_path, "xx-page.sql.gz", lines + again), "xx")
    out = str(tmp_path / "out")
    assert load_dataset(spark, "pages", src, out, "xx") == (200, 200)
    assert load_dataset(spark, "pages", src, out, "xx") == (200, 200)
    got = {r.page_id: r.page_title for r in spark.read.parquet(f"{out}/pages").collect()}
    assert got == {i: f"First_{i}" for i in range(200)}


def test_truncated_load_is_not_flagged(spark, tmp_path):
    import pytest
    from quire.plans.load import load_corpus, load_plan, read_manifest
    from quire.sources.articles import read_articles
    from quire.sources.metadata import read_language_metadata
    meta = tmp_path / "meta.csv"
    meta.write_text("subset,pages\nxx,500\nyy,2\n")
    out = str(tmp_path / "out")
    typed = read_language_metadata(spark, str(meta))
    plan = load_plan(["xx", "yy"], typed, read_manifest(spark, out))
    assert {(r.language_code, r.dataset, r.expected_rows) for r in plan.collect() if r.dataset == "redirections"} == {
        ("xx", "redirections", 0), ("yy", "redirections", 0)}
    spark.createDataFrame([(1, "One", "text")], "page_id long, title string, text string").write.parquet(str(tmp_path / "xx"))
    spark.createDataFrame([(1, "One", "a"), (2, "Two", "b"), (1, "Again", "c")], "page_id long, title string, text string").coalesce(1).write.parquet(str(tmp_path / "yy"))
    sources = {("documents", x): read_articles(spark, str(tmp_path / x), x) for x in ("xx", "yy")}
    flags = {(r.language_code, r.dataset, r.n_rows) for r in load_corpus(spark, plan, sources, out).collect()}
    assert flags == {("yy", "documents", 2)}
    assert {r.title for r in spark.read.parquet(f"{out}/documents").where("language_code = 'yy'").collect()} == {"One", "Two"}
    again = load_plan(["xx", "yy"], typed, read_manifest(spark, out))
    assert {(r.language_code, r.status) for r in again.collect() if r.dataset == "documents"} == {("xx", "target"), ("yy", "complete")}
    (tmp_path / "broken" / "_manifest").mkdir(parents=True)
    (tmp_path / "broken" / "_manifest" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_manifest(spark, str(tmp_path / "broken")).collect()


def test_stored_tables_prune_languages_and_keys(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.plans.load import load_dataset, stored
    out = str(tmp_path / "out")
    for lang in ("xx", "yy"):
        rows = spark.range(100).select(F.col("id").alias("page_id"), F.lit(0).alias("page_namespace"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("page_title"),
                                       F.lit(lang).alias("language_code"), F.col("id").alias("_order"))
        load_dataset(spark, "pages", rows, out, lang)
    df = stored(spark, f"{out}/pages", "xx").filter(F.col("page_title") == "T5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language_code" in plan and "EqualTo(page_title,T5)" in plan
    assert df.count() == 1


def test_indexes_are_built_by_language_and_read_pruned(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F
    from quire.plans.load import build_indexes, load_dataset, open_corpus
    out = str(tmp_path / "out")
    with pytest.raises(ValueError):
        build_indexes(spark, out, ["xx"])
    for lang in ("xx", "yy"):
        one = F.lit(0).alias("_order")
        load_dataset(spark, "pages", spark.range(3).select(F.col("id").alias("page_id"), F.lit(0).alias("page_namespace"), F.lit("Title").alias("page_title"), F.lit(lang).alias("language_code"), one), out, lang)
        load_dataset(spark, "documents", spark.range(3).select(F.col("id").alias("page_id"), F.lit("Title").alias("title"), F.lit(f"body of {lang}").alias("text_body"), F.lit(lang).alias("language_code"), one), out, lang)
        load_dataset(spark, "redirections", spark.range(2).select(F.col("id").alias("from_page_id"), F.lit("Title").alias("to_title"), F.lit(lang).alias("language_code")), out, lang)
        build_indexes(spark, out, [lang])  # the other language's partitions stay
    c = open_corpus(spark, out, ["xx", "yy"])
    got = {(r.language_code, r.term, r.n) for r in c.postings.filter("field = 'body'").groupBy("language_code", "term").agg(F.count("*").alias("n")).collect()}
    assert got == {(x, t, 3) for x in ("xx", "yy") for t in ("body", "of", x)}
    assert {(r.language_code, r.gram) for r in c.title_grams.collect()} >= {("xx", "tit"), ("yy", "e")}
    plan = c.postings.filter((F.col("field") == "body") & (F.col("language_code") == "xx") & (F.col("term") == "of"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan or "PartitionFilters: [isnotnull(language_code" in plan
    assert "EqualTo(term,of)" in plan


def test_a_cut_off_source_is_never_flagged(spark, tmp_path):
    """Dumps and article files cut off at any share stay targets; the whole
    ones are flagged.  A dump counts as whole by its closing statement, even if
    the metadata, which counts pages of all kinds, expects more rows."""
    from pyspark.sql import Observation
    from quire.plans.load import load_corpus, load_plan, read_manifest
    from quire.sources.articles import read_articles
    from quire.sources.metadata import read_language_metadata
    shares = {"a": 60, "b": 90, "c": 99, "d": 100}
    meta = tmp_path / "meta.csv"
    meta.write_text("subset,pages,redirections\n" + "".join(f"{x},100,50\n" for x in shares))
    sources, seen = {}, []
    for x, share in shares.items():
        inserts = [f"INSERT INTO `page` VALUES ({i},0,'T{i}',0);" for i in range(80)]
        lines = (inserts + ["/*!40000 ALTER TABLE `page` ENABLE KEYS */;"])[:81 if share == 100 else 80 * share // 100]
        seen.append(Observation())
        sources["pages", x] = read_page_dump(spark, _write(tmp_path, f"{x}-page.sql.gz", lines), x, seen=seen[-1]), seen[-1]
        inserts = [f"INSERT INTO `redirect` VALUES ({i},0,'T{i}','','');" for i in range(50)]
        seen.append(Observation())
        lines = inserts + ["/*!40000 ALTER TABLE `redirect` ENABLE KEYS */;"] if share == 100 else inserts[:50 * share // 100] + ["/*!40000 ALTER TABLE `page` ENABLE KEYS */;"]
        sources["redirections", x] = read_redirect_dump(spark, _write(tmp_path, f"{x}-redirect.sql.gz", lines), x, seen=seen[-1]), seen[-1]
        spark.range(share).selectExpr("id AS page_id", "'t' AS title", "'b' AS text").coalesce(1).write.parquet(str(tmp_path / x))
        sources["documents", x] = read_articles(spark, str(tmp_path / x), x)
    out = str(tmp_path / "out")
    plan = load_plan(list(shares), read_language_metadata(spark, str(meta)), read_manifest(spark, out))
    flags = {(r.language_code, r.dataset, r.n_rows, r.expected_rows) for r in load_corpus(spark, plan, sources, out).collect()}
    assert flags == {("d", "pages", 80, 100), ("d", "redirections", 50, 50), ("d", "documents", 100, 100)}


def test_a_source_is_read_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.plans.load import load_dataset
    read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            read.add(len(b))
            yield b

    for dataset, key, value in (("pages", "page_id", "page_title"), ("documents", "page_id", "title"), ("redirections", "from_page_id", "to_title")):
        src = spark.range(500).select(F.col("id").alias(key), F.lit("x").alias(value), F.lit("xx").alias("language_code"), F.col("id").alias("_order"))
        before = read.value
        assert load_dataset(spark, dataset, src.mapInPandas(tell, src.schema), str(tmp_path), "xx") == (500, 500)
        assert read.value - before == 500


def test_bad_bytes_are_dropped(spark, tmp_path):
    p = tmp_path / "xx-page.sql.gz"
    with gzip.open(p, "wb") as f:
        f.write(b"INSERT INTO `page` VALUES (1,0,'Caf\xe9_Noir',0),(2,0,'\xff\xfeOdd',0);\n")
    assert sorted((r.page_id, r.page_title) for r in read_page_dump(spark, str(p), "xx").collect()) == [(1, "Caf_Noir"), (2, "Odd")]
