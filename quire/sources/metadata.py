"""The language metadata CSV (one row per language subset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


COUNTS = ("pages", "redirections")


def typed_metadata(raw: DataFrame, key: str = "subset") -> DataFrame:
    """Digit-only values become BIGINT, others stay strings; a later row
    for the same key replaces an earlier one (``_order`` gives file order);
    a missing count column reads as 0."""
    for c in COUNTS:  # a file without a count column counts nothing
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit("0"))
    cols = [c for c in raw.columns if c != "_order"]
    typed = []
    for c in cols:
        v = F.col(c)
        as_int = F.when(v.rlike(r"^[0-9]+$"), v.try_cast("bigint"))
        typed.append(as_int.alias(c + "__n"))
    out = raw.select("*", *typed)
    w = Window.partitionBy(key).orderBy(F.col("_order").desc())
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_order")


def read_language_metadata(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path).withColumn("_order", F.monotonically_increasing_id())
    return typed_metadata(raw)
