"""Bucketed lookup tables: no shuffle of the corpus, row groups skipped by Bloom filters."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import lookup
from quire.operators.corpus import Corpus
from quire.plans import buckets


@pytest.fixture
def shuffled(spark):
    """Neither broadcasts nor run-time changes of the plan."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def corpus(spark, n=600):
    ids = spark.range(n).withColumn("language_code", F.when(F.col("id") % 3 == 0, "fr").otherwise("en"))
    title = F.concat(F.lit("T"), (F.col("id") % 450).cast("string"))
    docs = ids.select(F.col("id").alias("page_id"), "language_code", title.alias("title"), F.lit("text").alias("text_body"))
    pages = ids.select((F.col("id") + 10000).alias("page_id"), F.lit(0).alias("page_namespace"), F.concat(F.lit("Alias_"), title).alias("page_title"), "language_code")
    redirections = ids.select((F.col("id") + 10000).alias("from_page_id"), title.alias("to_title"), "language_code")
    return Corpus(documents=docs, pages=pages, redirections=redirections, languages=["en", "fr"])


def keys(spark):
    rows = [(i, 0, 0, v, lang) for i, (v, lang) in enumerate((v, lang) for v in ["T1", "Alias T2", "Alias T449", "T3", "none", "alias T4"] * 40 for lang in ("en", "fr"))]
    return spark.createDataFrame(rows, "request_id long, variant_rank int, lang_rank int, variant string, language_code string")


def exchanges_above(plan, table):
    """Exchanges between each scan of the table and the first join above it."""
    lines = [(len(re.match(r"[^A-Za-z*(]*", x)[0]), x) for x in plan.split("\n") if x.strip()]
    found = []
    for i, (depth, line) in enumerate(lines):
        if "FileScan parquet" in line and table in line:
            assert "Bucketed: true" in line
            between = []
            for d, up in reversed(lines[:i]):
                if d < depth:
                    depth = d
                    if "Join" in up:
                        break
                    between.append("Exchange" in up)
            found.append(sum(between))
    return found


def test_lookups_do_not_shuffle_the_corpus(spark, shuffled, tmp_path):
    plain, k = corpus(spark), keys(spark)
    stored = buckets.store_corpus(plain, str(tmp_path), buckets=8)
    for find in (lambda c: lookup.exact_titles(k, c.documents), lambda c: lookup.exact_redirects(k, c.documents, c.pages, c.redirections)):
        got = find(stored)
        plan = got._jdf.queryExecution().executedPlan().toString()
        counts = exchanges_above(plan, "quire_")
        assert counts and not any(counts), plan
        assert sorted(got.collect()) == sorted(find(plain).collect()) and got.count()
    # the reduction to one row a key, above the semi-join, reuses the buckets, too
    reduced = lookup.exact_titles(k, stored.documents)._jdf.queryExecution().executedPlan().toString()
    assert reduced.count("Exchange hashpartitioning") == plan_exchanges_of_requests(k)


def plan_exchanges_of_requests(k):
    """Requests are dealt once to be made distinct, which suits the semi-join, and once for the last join."""
    return 2


def test_buckets_are_found_again(spark, tmp_path):
    stored = buckets.store_corpus(corpus(spark), str(tmp_path), buckets=8)
    want = sorted(map(tuple, stored.pages.collect()))
    spark.sql(f"DROP TABLE {buckets._table(f'{tmp_path}/pages', 'pages')}")
    again = buckets.open_corpus(spark, str(tmp_path), ["en", "fr"])
    assert sorted(map(tuple, again.pages.collect())) == want
    assert "Exchange" not in again.pages.groupBy("language_code", "page_title").count()._jdf.queryExecution().executedPlan().toString()
    assert len([f for f in (tmp_path / "pages").iterdir() if f.suffix == ".parquet"]) == 8


def rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_bloom_filters_skip_row_groups(spark, shuffled, tmp_path):
    """Titles that lie between a row group's least and greatest, but not in it."""
    stored = buckets.store_corpus(corpus(spark, 3000), str(tmp_path), buckets=2)
    for table, column, there, absent in ((stored.redirections, "to_title", "T7", "T7x"), (stored.documents, "page_id", 1234, None), (stored.redirections, "from_page_id", 10007, None), (stored.pages, "page_title", "Alias_T7", "Alias_T7x")):
        assert rows_scanned(table.where(F.col(column) == there)) > 0
        if absent:
            assert rows_scanned(table.where(F.col(column) == absent)) == 0
    # unsorted ids: a gap in them is skipped as well
    gaps = corpus(spark, 3000).redirections.withColumn("from_page_id", F.col("from_page_id") * 2)
    gaps = buckets.write_bucketed(gaps.withColumn("to_title", F.concat("to_title", F.lit("_"))), str(tmp_path / "gaps"), "redirections", buckets=2)
    assert rows_scanned(gaps.where("from_page_id = 20001")) == 0 and rows_scanned(gaps.where("to_title = 'T9'")) == 0
    assert rows_scanned(gaps.where("to_title = 'T9_'")) > 0


def test_redirects_to_few_and_many_titles(spark, tmp_path):
    c = buckets.store_corpus(corpus(spark), str(tmp_path), buckets=8)
    for n in (3, 1200):
        asked = spark.range(n).select(F.lit("en").alias("language_code"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("to_title"))
        got = {tuple(r) for r in buckets.redirect_sources(asked, c.redirections).collect()}
        want = {("en", f"T{i % 450}", i + 10000) for i in range(600) if i % 3 and i % 450 < n}
        assert got == want
