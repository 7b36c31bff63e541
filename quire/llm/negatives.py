"""Hard-negative mining by angular triangle filtering (operator 13).

Components become integers, ``floor(256 x)``; a row's score is its integer inner
product with the anchor.  Anchors are the rows whose id divides by ``EVERY``:
the stated query set, met by all rows block by block.  Each anchor's positives
are its ``POSITIVES`` best other rows of its label; for each of them the
``NEGATIVES`` best rows of another label are returned whose score lies between
``LOW`` and ``HIGH`` per cent of the positive's.

1. Every row stores its norm and its angles to a few reference directions, which
   are picked far apart from a sample of ``SAMPLE`` rows.  Rows are written
   sorted by nearest reference and angle to it, so neighbours in the table are
   neighbours on the sphere.  The range partitions end in the row's number: many
   equal vectors spread over tasks.
2. A task reads its rows in windows of ``WINDOW``.  By the triangle inequality
   the angle between an anchor and a row lies between |s - t| and s + t (or its
   mirror beyond pi), s and t being their angles to a reference; the tightest
   reference gives a cosine interval for the window, which the norms turn into
   score bounds, widened beyond rounding.
3. Only windows whose bounds overlap what an anchor still wants (its range, and
   the worst of its best so far) are scored, in integers.  Each task hands on
   its best rows of each anchor; a window function merges them.

Nothing else limits the search: every row is indexed, all candidates within the
bounds are scored, so the results are exact.  A block of ``BLOCK`` anchors is
broadcast at a time, and its results are written before the next one.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part.  A null id is no anchor and comes last among ties.
Repeated ids are rows of their own; ties among them are settled by the row's
place in the index.  Vectors of different lengths meet as if the shorter one
ended in zeros.  Scaled components beyond 2^62 count as 2^62, and so do scores.
Other columns are not read.  Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
REFERENCES = 16
SAMPLE = 4096
WINDOW = 256
BLOCK = 4096
#: Candidates kept by a task before they are cut to the best.
PENDING = 1 << 18
LIMIT = 1 << 62
#: Angles are widened by this, scores by one and this share.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9

INDEX = "row long, id long, label long, q array<long>, norm double, angles array<double>, cell int, near double"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows, shorter ones ending in zeros."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    wide = int(n.max(initial=0))
    if len(n) and (n == wide).all():
        return flat[at[0]:at[-1]].reshape(len(n), wide)
    out = np.zeros((len(n), wide), flat.dtype)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = flat[at[0]:at[-1]]
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two int64 matrices."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    if max(1, width) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)  # every partial sum is an exact double
    return np.clip(a.astype(object) @ b.T.astype(object), -LIMIT, LIMIT).astype(np.int64)


def norms(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q.astype(np.float64) ** 2).sum(1))


def angles_to(references: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Angle of every row to every unit reference; a zero vector counts as at right angles."""
    width = max(q.shape[1], references.shape[1])
    dot = _wide(q, width).astype(np.float64) @ _wide(references, width).T
    return np.arccos(np.clip(dot / np.maximum(norm, 1e-300)[:, None], -1, 1))


def pick_references(q: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each the furthest from those before it."""
    norm = norms(q)
    unit = q[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.zeros((0, q.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, q): rows that take part, as integers.  Every seventh id's label moves on by one."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    edge = F.lit(float(LIMIT))
    return rows.select("id", moved.alias("label"), F.transform("v", lambda x: F.floor(F.greatest(-edge, F.least(edge, SCALE * x)))).alias("q"))


def build_index(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> DataFrame:
    """The angular index of (id, label, q), written sorted by cell and angle."""
    picked = rows.select("q").orderBy(F.xxhash64("id", "q")).limit(sample).toArrow()["q"].combine_chunks()  # at most `sample` rows
    refs = pick_references(matrix(picked).astype(np.float64), references) if len(picked) else np.zeros((0, 0))
    sent = rows.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch["q"])
            norm = norms(q)
            angles = angles_to(sent.value, q, norm)
            cell = angles.argmin(1) if angles.shape[1] else np.zeros(len(q), int)
            near = angles.min(1, initial=np.pi)
            listed = pa.ListArray.from_arrays(np.arange(0, angles.size + 1, angles.shape[1], dtype=np.int32) if angles.size else np.zeros(len(q) + 1, np.int32), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["label"], batch["q"], pa.array(norm), listed, pa.array(cell.astype(np.int32)), pa.array(near)],
                                             ["row", "id", "label", "q", "norm", "angles", "cell", "near"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "q")
    return materialize(numbered.mapInArrow(run, INDEX).repartitionByRange("cell", "near", "row").sortWithinPartitions("cell", "near", "row"), "angular")


@dataclass
class Wanted:
    """A block of anchors and what each of its groups (anchor, slot) still wants."""

    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angles: np.ndarray
    low: np.ndarray  # (anchors, slots), int64; low > high: no such group
    high: np.ndarray
    same_label: bool
    best: int


def bounds(w: Wanted, least: np.ndarray, most: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds (anchors, windows) from the windows' smallest and largest
    angles to every reference, and smallest and largest norms."""
    near, far = np.zeros((len(w.row), len(least))), np.full((len(w.row), len(least)), np.pi)
    for r in range(w.angles.shape[1]):
        s = w.angles[:, r, None]
        near = np.maximum(near, np.maximum(s - most[:, r], least[:, r] - s))
        top = np.where(s + most[:, r] <= np.pi, s + most[:, r], np.where(s + least[:, r] >= np.pi, 2 * np.pi - s - least[:, r], np.pi))
        far = np.minimum(far, top)
    up, down = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    n = w.norm[:, None]
    slack = 1 + SCORE_SLACK * n * long
    return n * np.where(up > 0, long, short) * up + slack, n * np.where(down > 0, short, long) * down - slack


class Best:
    """The best rows of every group that a task has met."""

    def __init__(self, groups: int, k: int):
        self.k, self.worst, self.kept, self.pending = k, np.full(groups, -LIMIT - 1), None, []
        self.waiting = 0

    def add(self, *columns: np.ndarray) -> None:
        self.pending.append(columns)
        self.waiting += len(columns[0])
        if self.waiting > PENDING:
            self.cut()

    def cut(self) -> None:
        """group, score, nameless, id, row: only the first k of each group stay."""
        parts = ([self.kept] if self.kept else []) + self.pending
        if not parts:
            return
        group, score, nameless, name, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, name, nameless, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order = order[place < self.k]
        self.kept = tuple(x for x in (group[place < self.k], score[order], nameless[order], name[order], row[order]))
        full = place[place < self.k] == self.k - 1
        self.worst[self.kept[0][full]] = self.kept[1][full]
        self.pending, self.waiting = [], 0


def search(index: DataFrame, wanted: Wanted) -> DataFrame:
    """The best rows (anchor, slot, score, id, row) of each task for each group."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)
    names = ["anchor", "slot", "score", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        slots = w.low.shape[1]
        best = Best(w.low.size, w.best)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.arange(0, batch.num_rows, WINDOW)
            angles, norm = matrix(batch["angles"]), batch["norm"].to_numpy()
            up, down = bounds(w, np.minimum.reduceat(angles, first), np.maximum.reduceat(angles, first), np.minimum.reduceat(norm, first), np.maximum.reduceat(norm, first))
            q, label, row = matrix(batch["q"]), batch["label"].to_numpy(), batch["row"].to_numpy()
            nameless = batch["id"].is_null().to_numpy(zero_copy_only=False)
            name = batch["id"].fill_null(0).to_numpy()
            for i, at in enumerate(first):
                least = np.maximum(w.low, best.worst.reshape(w.low.shape))
                open_groups = (up[:, i, None] >= least) & (down[:, i, None] <= w.high) & (least <= w.high)
                anchors = np.flatnonzero(open_groups.any(1))
                if not len(anchors):
                    continue
                here = slice(at, at + WINDOW)
                score = inner(w.q[anchors], q[here])
                match = (label[here] == w.label[anchors, None]) == w.same_label
                match &= row[here] != w.row[anchors, None]
                for slot in range(slots):
                    a, x = np.nonzero(match & (score >= least[anchors, slot, None]) & (score <= w.high[anchors, slot, None]))
                    if len(a):
                        best.add(anchors[a] * slots + slot, score[a, x], nameless[here][x], name[here][x], row[here][x])
                if i % 8 == 0:
                    best.cut()
        best.cut()
        if best.kept:
            group, score, nameless, name, row = best.kept
            yield pa.RecordBatch.from_arrays([pa.array(w.row[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(name, mask=nameless), pa.array(row)], names)

    return index.select("id", "row", "label", "q", "norm", "angles").mapInArrow(run, "anchor long, slot int, score long, id long, row long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each group over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(anchors: DataFrame, number: int) -> tuple[list, Wanted]:
    got = anchors.where(F.col("block") == number).orderBy("row").toArrow().combine_chunks()  # about BLOCK anchors
    column = lambda name: got[name].combine_chunks() if got.num_rows else got[name]
    n = got.num_rows
    low, high = np.full((n, 1), -LIMIT - 1), np.full((n, 1), LIMIT)
    return got["id"].to_pylist(), Wanted(got["row"].to_numpy(), got["label"].to_numpy(), matrix(column("q")), got["norm"].to_numpy(), matrix(column("angles")), low, high, True, POSITIVES)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) per anchor, positive and hard negative."""
    spark = vectors.sparkSession
    index = build_index(usable(vectors, id_col, vec_col, label_col))
    chosen = index.where(F.col("id") % every == 0)
    count = chosen.count()
    blocks = -(-count // block)
    parts = []
    if count:
        # Anchors that lie close together meet the same windows.
        dealt = chosen.repartitionByRange(blocks, "cell", "near", "row") if blocks > 1 else chosen.coalesce(1)
        anchors = materialize(dealt.withColumn("block", F.spark_partition_id()), "anchors")
    for number in range(blocks):
        ids, wanted = _block(anchors, number)
        if not len(ids):
            continue
        wanted.best = positives
        pairs = materialize(_merged(search(index, wanted), positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        at = {row: i for i, row in enumerate(wanted.row.tolist())}
        wanted.low, wanted.high = np.full((len(ids), positives), 1), np.zeros((len(ids), positives), np.int64)
        for p in pairs.collect():  # at most `positives` rows an anchor of this block
            wanted.low[at[p["anchor"]], p["slot"]] = -(-low * p["positive_score"] // 100)
            wanted.high[at[p["anchor"]], p["slot"]] = high * p["positive_score"] // 100
        wanted.same_label, wanted.best = False, negatives
        found = _merged(search(index, wanted), negatives)
        named = pairs.join(spark.createDataFrame(list(zip(wanted.row.tolist(), ids, strict=True)), "anchor long, anchor_id long"), "anchor")
        parts.append(materialize(found.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "slot"]), "negatives"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0].select(names)
    for more in parts[1:]:
        out = out.union(more.select(names))
    return out
