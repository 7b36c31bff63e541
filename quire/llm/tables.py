"""Tables of the training-data queries, and components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A number of each row, whatever its id.
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``ROW`` that no two rows share, written so that it stays."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): one row (id,
    component) per linked id, component being the smallest id reachable.

    Every round points each id to the smallest id among itself and its
    neighbours, halves the paths, and contracts the links along them, until
    no link is left; a link table of n ids needs about log n rounds.  Each
    round is written to the shared folder.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        near = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        to = near.groupBy("id").agg(F.least("id", F.min("to")).alias("to"))
        jump = to.select(F.col("id").alias("to"), F.col("to").alias("further"))
        to = materialize(to.join(jump, "to").select("id", F.col("further").alias("to")), "pointers")
        if found is None:
            found = to.select("id", F.col("to").alias("component"))
        else:
            found = found.join(to.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        found = materialize(found, "components")
        left = links.join(to.select(F.col("id").alias("a"), F.col("to").alias("p")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("q")), "b")
        links = materialize(left.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found
