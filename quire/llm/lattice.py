"""Embedding near-dedup by E8 lattice hashing (operator 1).

A table projects unit vectors on ``BLOCKS`` times 8 random directions and
decodes every 8 coordinates to the nearest point of the E8 lattice; the points,
the label and the table make a cell.  A vector lives in one cell of each table
and also probes the cells of its nearest neighbouring lattice points, one block
changed at a time.  Vectors are only compared within a label.

1. Equal vectors of a label are one class with a weight.
2. A vector is compared with the smallest class at home in each probed cell;
   cosines (double precision) confirm links, links give components.
3. Cells then hold components, not vectors.  Two components that share a cell
   are linked if any two members are: by the triangle inequality on angles that
   is ruled out where their first members are further apart than the threshold
   and both radii together; what remains is compared in blocks of vectors.
4. Link counts come from comparing each component with itself in blocks, so a
   pair is seen once, whatever cells it shares, and no pair is ever a row.

The share of pairs at the threshold itself that meet in a cell is above 0.9999
(`tests/llm`), and links inside a component are all counted.

Defined cases: a null label, a null, empty or zero vector, null or
non-finite components: linked with nothing, n_links 0, component_id the own
id, kept true.  A null id links like any other, names no component and is not
kept (component_id null if no member has an id).  Repeated ids with other
vectors or labels are vectors of their own.  Vectors of different lengths are not
compared.  Labels that are no integers are compared by a 64-bit hash.  Repeated
rows are vectors of their own.  Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import components
from quire.llm.words import mix64
from quire.session import materialize

COSINE = 0.93
TABLES = 16
BLOCKS = 3
PROBES = 4
#: Root mean square length of the projected difference of two vectors at the threshold.
STEP = 0.4
#: Vectors in a block of a component.
BLOCK = 1024
ROWS = 512


@lru_cache(1)
def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(1) % 2)
    gap = (y - r)[odd]
    worst = np.abs(gap).argmax(1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(4)
def _projection(dim: int, tables: int, blocks: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8 * dim + tables)
    reach = np.sqrt(2 - 2 * cosine)
    return rng.normal(size=(dim, tables * blocks * 8)) * (STEP / (reach * np.sqrt(8))), rng.uniform(0, 2, tables * blocks * 8)


def _code(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points), np.uint64)
    for column in (2 * points).astype(np.int64).view(np.uint64).T:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def cells(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, cosine: float = COSINE) -> np.ndarray:
    """(vectors, tables, 1 + blocks * probes) cell hashes, the home cell first."""
    n, dim = unit.shape
    project, shift = _projection(dim, tables, blocks, cosine)
    y = (unit @ project + shift).reshape(-1, 8)
    home = nearest_e8(y)
    towards = (y - home) @ _neighbours().T
    best = np.argpartition(-towards, probes, 1)[:, :probes]
    own = _code(home).reshape(n, tables, blocks)
    near = _code((home[:, None] + _neighbours()[best]).reshape(-1, 8)).reshape(n, tables, blocks, probes)
    out = np.zeros((n, tables, 1 + blocks * probes), np.uint64)
    salt = mix64(labels.astype(np.int64).view(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(dim))[:, None]
    for b in range(blocks):
        column = np.repeat(own[:, :, b, None], out.shape[2], 2)
        column[:, :, 1 + b * probes:1 + (b + 1) * probes] = near[:, :, b]
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return mix64(out + mix64(salt + np.arange(tables, dtype=np.uint64))[:, :, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed double vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _pack(classes: DataFrame) -> DataFrame:
    """(class, label, weight, unit): unit vectors as packed doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["embedding"]
            flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), v.offsets.to_numpy()
            at = at - at[0]
            unit = [_unit(flat[None, i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["class"], batch["label"], batch["weight"], pa.array(unit, pa.binary())], ["class", "label", "weight", "unit"])

    return classes.mapInArrow(run, "class long, label long, weight long, unit binary")


def _probed(vectors: DataFrame, home_only: bool, **shape) -> DataFrame:
    """(cell, class) of the cells that each vector is at home in, or probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.array([len(x) for x in batch["unit"].to_pylist()])
            for n in np.unique(length):
                same = batch.filter(pa.array(length == n))
                for i in range(0, same.num_rows, ROWS):
                    part = same.slice(i, ROWS)
                    found = cells(_matrix(part["unit"]), part["label"].to_numpy(), **shape)
                    found = found[:, :, :1] if home_only else found
                    found = found.reshape(part.num_rows, -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(part["class"].to_numpy(), found.shape[1]))], ["cell", "class"])

    return vectors.select("class", "label", "unit").mapInArrow(run, "cell long, class long")


def _cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs of classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.array([np.dot(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)) if len(x) == len(y) else -1.0
                               for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(cosine)], ["a", "b", "cosine"])

    x = vectors.select(F.col("class").alias("a"), F.col("unit").alias("x"))
    y = vectors.select(F.col("class").alias("b"), F.col("unit").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cosine double")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[0][key][0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cut.tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _blocked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``members`` dealt to tasks, one task for each two blocks of the
    two components of a pair: (task, side, class, weight, unit).

    pairs: (p, q) of components; p = q compares a component with itself.
    """
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("class"), "blocks"))
    wide = pairs.join(blocks.select(F.col("component").alias("p"), F.col("blocks").alias("np")), "p").join(blocks.select(F.col("component").alias("q"), F.col("blocks").alias("nq")), "q")
    left = wide.join(dealt.withColumnRenamed("component", "p"), "p").select(
        "p", "q", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("j"), F.lit(0).alias("side"), "class", "weight", "unit")
    right = wide.join(dealt.withColumnRenamed("component", "q"), "q").select(
        "p", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "class", "weight", "unit")
    rows = left.union(right).select(F.concat_ws(":", "p", "q", "i", "j").alias("task"), "side", "class", "weight", "unit")
    return rows.repartition("task").sortWithinPartitions("task", "side", "class")


def _compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Both sides of each task, and which pairs reach the threshold."""
    for task in groups(batches, "task"):
        side = task["side"].to_numpy()
        a, b = task.filter(pa.array(side == 0)), task.filter(pa.array(side == 1))
        if a.num_rows and b.num_rows:
            yield a, b, _matrix(a["unit"].combine_chunks()) @ _matrix(b["unit"].combine_chunks()).T >= cosine


def _linked_across(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(a, b): one link of each two blocks that have any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, near in _compared(batches, cosine):
            i, j = np.unravel_index(int(near.argmax()), near.shape)
            if near[i, j]:
                yield pa.RecordBatch.from_arrays([pa.array([a["class"][int(i)].as_py()]), pa.array([b["class"][int(j)].as_py()])], ["a", "b"])

    return _blocked(pairs, members).mapInArrow(run, "a long, b long")


def _link_counts(members: DataFrame, cosine: float) -> DataFrame:
    """(class, links): weight of the other classes that a class links with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, near in _compared(batches, cosine):
            x, y = a["class"].to_numpy(), b["class"].to_numpy()
            near &= x[:, None] != y[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(near @ b["weight"].to_numpy())], ["class", "links"])

    own = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select(F.col("component").alias("p"), F.col("component").alias("q"))
    return _blocked(own, members).mapInArrow(run, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
                 tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES) -> DataFrame:
    """One row (id_col, n_links, component_id, kept) per row of ``table``."""
    whole = table.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    valid = rows.where(usable)
    # Classes have numbers of their own: an id may repeat with another vector or label, or be null.
    classes = valid.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    vectors = materialize(_pack(classes.select("class", "label", "weight", "embedding")), "vectors")
    shape = {"tables": tables, "blocks": blocks, "probes": probes, "cosine": cosine}

    homes = materialize(_probed(vectors, True, **shape), "homes")
    first = homes.groupBy("cell").agg(F.min("class").alias("b"))
    probed = _probed(vectors, False, **shape).withColumnRenamed("class", "a")
    met = materialize(probed.join(first, "cell").where("a <> b").select("cell", "a", "b"), "met")
    stars = materialize(_cosines(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), vectors).where(F.col("cosine") >= cosine), "stars")
    found = components(stars)
    members = materialize(vectors.join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "members")

    # Cells as sets of components: homes of cells that some other vector met, and who met them.
    of = members.select("class", "component")
    at_home = homes.join(met.select("cell").distinct(), "cell", "left_semi").join(of, "class").select("cell", F.col("component").alias("q")).distinct()
    came = met.select("cell", F.col("a").alias("class")).join(of, "class").select("cell", F.col("component").alias("p")).distinct()
    touching = came.join(at_home, "cell").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    spread = _cosines(of.where("class <> component").select(F.col("component").alias("a"), F.col("class").alias("b")), vectors)
    radius = materialize(spread.groupBy("a").agg(F.acos(F.least(F.lit(1.0), F.min("cosine"))).alias("radius")), "radii")
    apart = _cosines(touching, vectors).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))))
    reach = F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)) + F.acos(F.lit(cosine)) + 1e-6
    close = apart.join(radius.select("a", F.col("radius").alias("x")), "a", "left").join(radius.select(F.col("a").alias("b"), F.col("radius").alias("y")), "b", "left")
    close = materialize(close.where(F.col("angle") <= reach).select(F.col("a").alias("p"), F.col("b").alias("q")), "close")
    across = materialize(_linked_across(close, members, cosine), "across")
    found = components(stars.select("a", "b").union(across))

    members = vectors.join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    members = materialize(members, "members")
    counts = _link_counts(members, cosine)
    known = members.select("class", "component", "weight").join(counts, "class", "left")
    known = materialize(classes.select("label", "embedding", "class", "least").join(known, "class"), "known")
    names = known.groupBy("component").agg(F.min("least").alias("name"))
    known = known.join(names, "component").select("label", "embedding", "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = valid.join(known, ["label", "embedding"]).select("id", "n_links", F.col("name").alias("component"))
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.union(rest)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
