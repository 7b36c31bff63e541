"""One random article among the given languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_article(documents: DataFrame, langs: list[str], seed: int | str | None = None) -> DataFrame:
    """The key is picked on a narrow projection (language, page id), so the
    top-1 never sorts text; the body is joined afterwards.  With ``seed``
    the choice is deterministic: the smallest md5 of page_id and seed."""
    keys = documents.filter(F.col("language_code").isin(*langs)).select("language_code", "page_id")
    if seed is None:
        order = F.rand()
    else:
        order = F.md5(F.concat(F.col("page_id").cast("string"), F.lit(str(seed))))
    pick = keys.withColumn("_o", order).orderBy("_o", "language_code", "page_id").limit(1).drop("_o")
    return pick.join(documents, ["language_code", "page_id"], "inner").select("title", "text_body")
