"""The article corpus of one language (parquet with title, text,
page_id), renamed to the documents schema; ``_order``
is a row's place in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_articles(spark: SparkSession, path: str, language_code: str) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(F.col("page_id").cast("long"), "title", F.col("text").alias("text_body"),
                    F.lit(language_code).alias("language_code"),
                    F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
                    .alias("_order"))
