"""Consistent-hash sharding with virtual nodes and bounded loads (operator 7).

The ring has ``CELLS`` cells; every shard owns ``vnodes`` of them and with each
the arc of cells before it.  A key sits in the cell of its hash and belongs to
the shard of its arc, as long as that shard has room; what is beyond a shard's
bound continues clockwise to the next shard with room.  With no slack the
bounds add up to the row count, so counts differ by one at most (law `rows`).

Only counts travel: rows are counted by cell, and a plan over the arcs (shards
x vnodes entries, whatever the data) says which ranks of an arc's keys go to
which shard, and at which slot they begin.  Ranks come from cell offsets and a
window within each cell.  Equal rows are counted, ranked and moved as one and
spread again at the end, so a key with a third of all rows is one row until
then.

Defined cases: null text has 0 bytes and a null checksum; null ids share a
cell; repeated rows get slots of their own; an empty table gives an empty
result.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import materialize

CELLS = 1 << 16
VNODES = 128
LAW = "rows"


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; one whose cell is taken
    goes to the next free cell."""
    if shards * vnodes > CELLS // 2:
        raise ValueError(f"{shards} x {vnodes} virtual nodes are too many for {CELLS} cells")
    taken: dict[int, int] = {}
    for replica in range(vnodes):  # one replica of every shard after another: a new shard takes cells last
        for shard in range(shards):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def bounds(total: int, own: list[int], slack: float) -> list[int]:
    """Most rows of each shard: (1 + slack) times the mean, rounded up; without
    slack the exact shares, the odd rows going to the fullest shards."""
    n = len(own)
    if slack > 0:
        return [-(-int(total * (1 + slack)) // n) + 1] * n
    first = sorted(range(n), key=lambda s: (-own[s], s))[: total % n]
    return [total // n + (s in first) for s in range(n)]


def plan(owners: list[int], counts: list[int], shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): every arc's keys go to its
    owner up to the bound, the rest clockwise to shards with room."""
    own = [0] * shards
    for shard, n in zip(owners, counts, strict=True):
        own[shard] += n
    room = bounds(sum(counts), own, slack)
    slot = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def place(arc: int, rank: int, shard: int) -> int:
        n = min(counts[arc] - rank, room[shard])
        if n > 0:
            out.append((arc, rank, rank + n, shard, slot[shard]))
            room[shard] -= n
            slot[shard] += n
        return rank + max(n, 0)

    reached = [place(arc, 0, shard) for arc, shard in enumerate(owners)]
    for arc, rank in enumerate(reached):
        step = 1
        while rank < counts[arc]:
            rank = place(arc, rank, owners[(arc + step) % len(owners)])
            step += 1
    return out


def _values(spark: SparkSession, rows: list[tuple[int, ...]], names: str) -> DataFrame:
    """A small table that is part of the plan."""
    if not rows:
        return _values(spark, [(0,) * len(names.split(", "))], names).where("false")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """One row (id_col, size, text_crc32, law, shard, slot, grown_shard) per row
    of ``docs``.  ``slack`` > 0 leaves more keys with their owners and lets
    counts differ by that share of the mean."""
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    owners = [s for _, s in nodes]
    # Arc i holds the cells after node i - 1 up to node i; the first also those after the last node.
    spans = [(i, (nodes[i - 1][0] + 1 if i else 0), cell) for i, (cell, _) in enumerate(nodes)] + [(0, nodes[-1][0] + 1, CELLS - 1)]
    arcs = _values(spark, [x for x in spans if x[1] <= x[2]], "arc, lo, hi")
    cells = F.broadcast(arcs.select("arc", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("cell")))  # CELLS rows

    keys = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("crc"))
    keys = keys.groupBy("id", "size", "crc").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("id"))
    keys = materialize(keys.withColumn("cell", F.pmod("h", F.lit(CELLS).cast("long"))).join(cells, "cell"), "keys")

    counted = keys.groupBy("arc", "cell").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # The first arc wraps: its cells after the last node come first clockwise, which no rank needs.
    counted = materialize(counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counted")
    counts = [0] * len(nodes)
    for arc, n in counted.groupBy("arc").agg(F.sum("n")).collect():  # shards x vnodes rows at most
        counts[arc] = n
    parts = F.broadcast(_values(spark, plan(owners, counts, shards, slack), "arc, lo, hi, shard, first"))

    place = Window.partitionBy("cell").orderBy("h", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.join(F.broadcast(counted.select("cell", "base")), "cell").withColumn("start", F.col("base") + F.coalesce(F.sum("copies").over(place), F.lit(0)))
    ranked = ranked.select("id", "size", "crc", "arc", F.explode(F.sequence("start", F.col("start") + F.col("copies") - 1)).alias("rank"))
    placed = ranked.join(parts, (ranked["arc"] == parts["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
