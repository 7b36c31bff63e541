"""Chat formatting: cumulative snapshots collapsed, then rendered (operator 4).

A conversation logged after every turn appears as several conversations, each a
prefix of the next.  Turn i of a conversation gets the rolling hash of turns 1
to i: the running XOR of two 64-bit hashes of (position, role, text).  A
conversation is a prefix of a longer one if its last hash equals a hash of a
turn before the last of another; an anti-join drops it.  Of equal
conversations the smallest id stays.  What remains is rendered.

Order and ties: turns are ordered by (turn, role, text), nulls first, and
numbered from 1; repeated rows are turns of their own.  A null conversation id
is a conversation like any other.  A null role renders as `unknown`, a null
text as the empty string, and both differ from those strings when compared.
Copies and prefixes are collapsed in aggregates before any join, so a third of
all conversations being copies of one moves one row per map task.  A rendered
conversation is one value, so its own turns meet in one task.  Empty input:
empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize


def render(role, text):
    """One turn in ChatML."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Position and prefix hashes of every turn, without its text."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = turns.withColumn("pos", F.row_number().over(order))
    so_far = Window.partitionBy("conv").orderBy("pos")
    hashed = placed.select("conv", "pos", F.xxhash64("pos", "role", F.col("role").isNull(), "text", F.col("text").isNull()).alias("x"),
                           F.xxhash64("text", F.col("text").isNull(), F.lit("second"), "pos", F.col("role").isNull(), "role").alias("y"))
    return hashed.select("conv", "pos", F.bit_xor("x").over(so_far).alias("x"), F.bit_xor("y").over(so_far).alias("y"),
                         F.count("*").over(Window.partitionBy("conv")).alias("turns"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, turns, copies) of the conversations that no longer one begins
    with; copies counts equal conversations, the smallest id (null before any)
    standing for them."""
    hashes = materialize(_numbered(turns), "prefixes")
    last = hashes.where("pos = turns").groupBy("pos", "x", "y").agg(F.min(F.struct("conv")).alias("least"), F.count("*").alias("copies"))
    inner = hashes.where("pos < turns").select("pos", "x", "y").distinct()
    return last.join(inner, ["pos", "x", "y"], "left_anti").select(F.col("least.conv").alias("conv"), F.col("pos").cast("long").alias("turns"), "copies")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (conv_col, n_turns, n_copies, rendered) per maximal conversation."""
    turns = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kept = materialize(maximal(turns), "maximal")
    texts = turns.join(kept.select("conv"), turns["conv"].eqNullSafe(kept["conv"]), "left_semi")
    joined = texts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    rendered = joined.select("conv", F.array_join(F.transform("all", lambda t: render(t["role"], t["text"])), "").alias("rendered"))
    out = kept.join(rendered.withColumnRenamed("conv", "same"), F.col("conv").eqNullSafe(F.col("same")))
    return out.select(F.col("conv").alias(conv_col), F.col("turns").alias("n_turns"), F.col("copies").alias("n_copies"), "rendered")
