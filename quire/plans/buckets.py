"""Lookup tables stored in buckets of their key.

A table's rows lie in the bucket that the hash of (language, key) names, sorted
by the key, one file a bucket.  A lookup then sends only the requests to the
buckets: the semi-join with the asked keys, the reduction to one row a key and
the join with the requests all use the stored distribution, so the corpus is
never shuffled.  Columns that are looked up without being the bucket key get
Parquet Bloom filters, which skip row groups that min and max cannot.

Buckets are known to Spark through its catalog only.  A folder ``_spec`` beside
the files says how they are cut, and ``open_bucketed`` registers them again in a
new session.
"""

from __future__ import annotations

import json
import re
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.corpus import Corpus
from quire.session import materialize

KEYS = {"documents": ["language_code", "title"], "pages": ["language_code", "page_title"], "redirections": ["language_code", "from_page_id"]}
BLOOM = {"documents": ["title", "page_id"], "pages": ["page_title", "page_id"], "redirections": ["from_page_id", "to_title"]}
#: Rows of a bucket; fewer buckets than ``LEAST`` leave executors idle.
ROWS, LEAST = 1_000_000, 8


def _table(path: str, dataset: str) -> str:
    return f"quire_{re.sub('[^a-z]', '', dataset)}_{md5(path.encode()).hexdigest()[:16]}"


def write_bucketed(df: DataFrame, path: str, dataset: str, buckets: int | None = None) -> DataFrame:
    """Stores a table in buckets of its key and opens it."""
    spark, keys = df.sparkSession, KEYS[dataset]
    rows = df.count()
    buckets = buckets or max(LEAST, -(-rows // ROWS))
    # The shuffle deals rows as buckets do, so that each task writes one file.
    writer = df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    for column in BLOOM[dataset]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", max(1000, rows // buckets))
    writer.option("path", path).saveAsTable(_table(path, dataset))
    spec = json.dumps({"dataset": dataset, "buckets": buckets, "columns": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{path}/_spec")
    return spark.table(_table(path, dataset))


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table stored at ``path``, with its buckets."""
    spec = json.loads(spark.read.text(f"{path}/_spec").first()[0])
    name = _table(path, spec["dataset"])
    if not spark.catalog.tableExists(name):
        keys = ", ".join(KEYS[spec["dataset"]])
        spark.sql(f"CREATE TABLE {name} ({spec['columns']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(spec['buckets'])} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def store_corpus(corpus: Corpus, out_dir: str, buckets: int | None = None) -> Corpus:
    """The corpus with its three tables stored in buckets under ``out_dir``."""
    stored = {d: write_bucketed(getattr(corpus, d), f"{out_dir}/{d}", d, buckets) for d in KEYS}
    return Corpus(languages=corpus.languages, **stored)


def open_corpus(spark: SparkSession, out_dir: str, languages: list[str]) -> Corpus:
    return Corpus(languages=languages, **{d: open_bucketed(spark, f"{out_dir}/{d}") for d in KEYS})


def redirect_sources(targets: DataFrame, redirections: DataFrame) -> DataFrame:
    """(language_code, to_title, from_page_id): the redirects that lead to any
    of a few titles (language_code, to_title).  ``to_title`` is no bucket key:
    the asked titles go to the scan as values, where Bloom filters skip row
    groups; beyond ``1000`` titles an ordinary join is used."""
    asked = materialize(targets.select("language_code", "to_title").distinct(), "targets")
    few = asked.limit(1001).collect()
    columns = redirections.select("language_code", "to_title", "from_page_id")
    if len(few) <= 1000:
        columns = columns.where(F.col("to_title").isin(*[r["to_title"] for r in few]))
    return columns.join(asked, ["language_code", "to_title"], "left_semi")
