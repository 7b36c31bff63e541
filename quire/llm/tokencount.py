"""Token counts by separator scan over flat token files (operator 6).

A flat token file is a run of token ids of a fixed width, documents one after
the other, each ended by an end-of-document id; nothing says where documents
begin.  Here a file is stored as raw blocks (file, block, data), as Spark's
readers deal it out.  Every block is searched on its own for separators: tokens
before the first, tokens after the last, and the lengths between.  A prefix scan
over the blocks of a file then adds what a document has in earlier blocks and
numbers the documents.  It runs in two levels, within ``SPAN`` blocks and over
such spans, so that one huge file is not one task.

``write_flat`` makes such files from texts (byte-level BPE; the separator is an
id that no text gives), with the order of the documents beside them.

Defined cases: null and empty texts are documents of 0 tokens; tokens after the
last separator are a document with ``closed`` false; an empty file has no
documents.  Repeated rows, null ids and ties: a row each.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words
from quire.session import materialize, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
WIDTH = 2
#: Bytes of a block.
BLOCK_BYTES = 1 << 20
#: Blocks of a span of the prefix scan.
SPAN = 1024


@lru_cache(1)
def _encoder(path: str):
    import base64

    import tiktoken
    from tiktoken_ext.openai_public import r50k_pat_str

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
               id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, order): blocks (file, block, data) of one flat file per
    partition, and the documents' order (file, first, ids)."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, first = TaskContext.get().partitionId(), 0, 0
        names = ["file", "block", "data", "first", "ids"]
        encode, held = _encoder(vocabulary).encode_ordinary, bytearray()

        def row(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([data], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64()))], names)

        for batch in batches:
            for part in words.chunks(batch, "text"):
                for text in part["text"]:
                    ids = encode(text.as_py() or "")
                    ids.append(end)
                    held += np.array(ids, kind).tobytes()
                    while len(held) >= block_bytes:
                        yield row(bytes(held[:block_bytes]))
                        del held[:block_bytes]
                        block += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([first]), pa.ListArray.from_arrays([0, part.num_rows], part["id"])], names)
                first += part.num_rows
        if held:
            yield row(bytes(held))

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "file long, block long, data binary, first long, ids array<long>")
    path = shared_dir(spark, "tokens")
    rows.write.option("maxRecordsPerFile", 64).parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.where("block is not null").select("file", "block", "data"), stored.where("block is null").select("file", "first", "ids")


def _searched(blocks: DataFrame, end: int, width: int) -> DataFrame:
    """Per block: documents ended, tokens, tokens before the first and after
    the last separator, and the lengths of the documents in between."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.frombuffer(data.as_buffer(), kind) == end) for data in batch["data"]]
            size = np.array([len(data.as_buffer()) // width for data in batch["data"]], np.int64)
            ended = np.array([len(s) for s in found], np.int64)
            head = np.array([s[0] if len(s) else n for s, n in zip(found, size, strict=True)], np.int64)
            tail = np.array([n - 1 - s[-1] if len(s) else n for s, n in zip(found, size, strict=True)], np.int64)
            inner = [np.diff(s) - 1 for s in found]
            edge = np.concatenate([[0], np.cumsum([len(x) for x in inner])]).astype(np.int32)
            lengths = pa.ListArray.from_arrays(edge, pa.array(np.concatenate(inner).astype(np.int64) if inner else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["block"], pa.array(ended), pa.array(size - ended), pa.array(head), pa.array(tail), lengths],
                ["file", "block", "ended", "tokens", "head", "tail", "lengths"])

    return blocks.mapInArrow(run, "file long, block long, ended long, tokens long, head long, tail long, lengths array<long>")


def scan_counts(blocks: DataFrame, end: int = END, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """One row (file, ordinal, n_tokens, closed) per document of flat token
    files given as (file, block, data); blocks hold whole ids."""
    rows = materialize(_searched(blocks, end, width), "separators").withColumn("span", F.floor(F.col("block") / span))
    zero = F.lit(0).cast("long")
    within = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"t": F.coalesce(F.sum("tokens").over(within), zero), "n": F.coalesce(F.sum("ended").over(within), zero)})
    # Tokens of the span up to its last separator so far.
    rows = rows.withColumn("closed_at", F.when(F.col("ended") > 0, F.col("t") + F.col("tokens") - F.col("tail")))
    rows = rows.withColumn("last", F.max("closed_at").over(within))
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("file", "span").agg(F.sum("tokens").alias("tokens"), F.sum("ended").alias("ended"), F.max("closed_at").alias("closed_at"))
    spans = spans.withColumns({"t0": F.coalesce(F.sum("tokens").over(over), zero), "n0": F.coalesce(F.sum("ended").over(over), zero)})
    spans = spans.withColumn("last0", F.coalesce(F.max(F.col("t0") + F.col("closed_at")).over(over), zero))
    rows = rows.join(spans.select("file", "span", "t0", "n0", "last0"), ["file", "span"])
    carried = F.col("t0") + F.col("t") - F.coalesce(F.col("t0") + F.col("last"), F.col("last0"))
    lengths = F.when(F.col("ended") > 0, F.concat(F.array(carried + F.col("head")), "lengths"))
    closed = rows.select("file", (F.col("n0") + F.col("n")).alias("base"), F.posexplode(lengths).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    files = spans.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("ended").alias("ordinal"), F.coalesce(F.max(F.col("t0") + F.col("closed_at")), zero).alias("closed_at"))
    rest = files.where("tokens > closed_at").select("file", "ordinal", (F.col("tokens") - F.col("closed_at")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_tokens) per row of ``docs``."""
    blocks, order = write_flat(docs, vocabulary, end, width, id_col=id_col, text_col=text_col)
    named = order.select("file", "first", F.posexplode("ids").alias("i", "id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "id")
    return named.join(scan_counts(blocks, end, width), ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
