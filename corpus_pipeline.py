"""Cleaning pipeline over `documents`: quality classifier, language ID, MinHash
near-dedup, benchmark decontamination, SentencePiece encoding and decoding.

Every stage gets what its predecessor kept, written as Parquet and reread; all
but the last return the columns of `documents`.  Null or empty texts go in the
first stage (no words, no quality).  Null and repeated ids are
no exception: the later stages tell rows apart by a number of their own.  An empty table stays
empty throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language, minhash, pieces, quality
from quire.llm.tables import ROW, numbered, table
from quire.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go."""
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    rows = numbered(docs)
    found = minhash.groups(rows.select(ROW, F.col("doc_id").cast("long").alias("id"), "text"))
    return rows.join(materialize(found.where("not kept").select(ROW), "copies"), ROW, "left_anti").select(docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    rows = numbered(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return rows.join(materialize(found.where("n_hit > 0").select(ROW), "leaks"), ROW, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, decoded again as a check."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("good_quality", good_quality), ("known_language", known_language), ("near_dedup", near_dedup), ("clean_of_benchmarks", clean_of_benchmarks), ("tokens", tokens)]

#: No SQL for trained models, Jaccard links and tokens: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
