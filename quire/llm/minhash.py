"""MinHash near-dedup with circulant signatures (operator 9).

A text's set is its distinct word shingles (64-bit hashes).  Two permutations
of a 2^32 universe give all signature coordinates: the first scatters the
shingles, the second is applied to them shifted by k, so coordinate k is
``min(pi(sigma(x) + k mod 2^32))``.  Rows of ``BAND_ROWS`` coordinates are
hashed into bands; equal bands make candidates.  Links are confirmed on the
full sets.

What is compared:

1. Texts with equal sets are one class (set hash of 128 bits), represented by
   its first row: the one with the smallest id, null ids last.  Groups of copies of any size end here.
2. Each band bucket compares its members with one hub only, the member that
   shares its buckets with most others: a number of pairs linear in the bucket.
   Confirmed links give components.
3. Members near the hub (Jaccard 0.5 or more) then stand for what tells them
   from it: the symmetric difference with the hub's set.  Two members differ by
   the difference of their differences, so those that link must share most of
   them.  Ordered rarest first within the hub's family, two members can only
   link if they share one of their first differences; members meet at those, in
   blocks of ``BLOCK`` compared by matrix products inside a task.  What leaves a
   task are links that join components, never pairs of a group.  (A pair whose
   differences need not overlap lies within the hub's own component.)
4. Members far from the hub (by the triangle inequality no link crosses the two
   overlapping ranges) choose a hub among themselves, ``ROUNDS`` times.  What is
   still open then is joined on the rarest shingles that leave room for the overlap.

At the threshold 0.85 a pair shares none of the 24 bands of 5 rows with
probability (1 - 0.85^5)^24 < 1e-6.

Defined cases: null or empty text, or text without words: empty set, linked
with nothing.  Rows are told apart by a number of their own, so null and
repeated ids are compared like any other: each row gets the component of its
own set, which is named by the smallest id of the group (null if it has none),
and ``kept`` is true for one row of each group, its first.
Other columns of the input are not read.  Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.tables import ROW, components, numbered
from quire.session import materialize

SHINGLE = 5
PERCENT = 85
BANDS = 24
BAND_ROWS = 5
#: Hubs that a bucket tries before what is far from all of them is joined on shingles.
ROUNDS = 2
#: Members compared at once.
BLOCK = 512


def sorted_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending, and where each text's begin."""
    s, text = words.shingles(*words.words(column, words.NOT_SPACE), size)
    at = np.searchsorted(text, np.arange(len(column) + 1))
    for i, j in zip(at[:-1], at[1:], strict=True):
        s[i:j].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    return s[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def _pi(x: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation, in place: invertible steps on 32 bits."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        x ^= spare
        if factor is not None:
            x *= np.uint32(factor)


def signatures(s: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) uint32; texts with an empty set keep the largest value."""
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        sigma = (words.mix64(s) >> np.uint64(32)).astype(np.uint32)
        x, spare = np.empty_like(sigma), np.empty_like(sigma)
        for k in range(n):
            np.add(sigma, np.uint32(k), out=x)
            _pi(x, spare)
            out[full, k] = np.minimum.reduceat(x, at[full])
    return out


def _band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        h = words.mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
    return words.mix64(h + np.arange(1, bands + 1, dtype=np.uint64))


def _signed(sig: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                s, at = sorted_sets(part["text"], size)
                n = np.diff(at)
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    a[full] = np.add.reduceat(words.mix64(s), at[full])
                    b[full] = np.add.reduceat(words.mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), at[full])
                h = _band_hashes(signatures(s, at, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [part[ROW], part["id"], pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, h.size + 1, bands, dtype=np.int32), pa.array(h.ravel().view(np.int64)))],
                    [ROW, "id", "n", "a", "b", "bands"])

    return sig.mapInArrow(run, f"{ROW} long, id long, n long, a long, b long, bands array<long>")


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                s, at = sorted_sets(part["text"], size)
                yield pa.RecordBatch.from_arrays(
                    [part["class"], pa.ListArray.from_arrays(at.astype(np.int32), pa.array(s.view(np.int64)))], ["class", "shingles"])

    return docs.mapInArrow(run, "class long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch["x"], batch["y"]
            xs, xo = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            ys, yo = y.flatten().to_numpy(zero_copy_only=False), y.offsets.to_numpy()
            xo, yo = xo - xo[0], yo - yo[0]
            for i in range(batch.num_rows):
                p, q = xs[xo[i]:xo[i + 1]], ys[yo[i]:yo[i + 1]]
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    with_a = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _against_hubs(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (a: hub, b: member) with b's size n, whether they link, are
    ``near`` or ``far``, and for near ones the symmetric difference d of their sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, xo = batch["x"].flatten().to_numpy(zero_copy_only=False), batch["x"].offsets.to_numpy()
            ys, yo = batch["y"].flatten().to_numpy(zero_copy_only=False), batch["y"].offsets.to_numpy()
            xo, yo = xo - xo[0], yo - yo[0]
            linked, near, far, found = *np.zeros((3, batch.num_rows), bool), []
            for i in range(batch.num_rows):
                both = np.concatenate([xs[xo[i]:xo[i + 1]], ys[yo[i]:yo[i + 1]]])
                both.sort()
                twice = both[1:] == both[:-1]
                common = int(twice.sum())
                union = len(both) - common
                linked[i], near[i], far[i] = 100 * common >= percent * union, 2 * common >= union, 100 * common < (150 - percent) * union
                once = np.ones(len(both), bool)
                once[1:] &= ~twice
                once[:-1] &= ~twice
                found.append(both[once] if near[i] else both[:0])
            at = np.concatenate([[0], np.cumsum([len(d) for d in found])]).astype(np.int32)
            d = pa.ListArray.from_arrays(at, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(np.diff(yo).astype(np.int64)), pa.array(linked), pa.array(near), pa.array(far), d], ["a", "b", "n", "linked", "near", "far", "d"])

    # Merge joins at every size: what is broadcast in a small table is shuffled in a large one, and costs are then hard to foretell.
    with_b = stars.hint("merge").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    hubs = sets.join(stars.select(F.col("a").alias("class")).distinct(), "class", "left_semi")
    with_a = with_b.hint("merge").join(hubs.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    return with_a.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, n long, linked boolean, near boolean, far boolean, d array<long>")


def _meetings(families: DataFrame, percent: int, block: int) -> DataFrame:
    """Members (a, b, component, n, d) of families that span several
    components, once for every block pair (a, s, lo, hi) in which they meet others."""
    spans = families.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    families = materialize(families.join(spans.select("a"), "a", "left_semi"), "families")
    each = families.select("a", "b", "component", "n", F.size("d").cast("long").alias("size"), F.explode("d").alias("s"))
    shared = each.groupBy("a", "s").agg(F.count("*").alias("df")).where("df > 1")
    member = Window.partitionBy("a", "b")
    each = each.join(shared, ["a", "s"]).withColumns({"later": F.count("*").over(member), "rank": F.row_number().over(member.orderBy("df", "s"))})
    # Differences that nobody shares come first.  A text of n shingles differs by `most` at most from one that it links with.
    each = each.withColumns({"room": F.col("later") - F.col("rank") + 1, "most": F.expr(f"({100 - percent} * n) div {percent}")})
    keyed = each.where(F.col("room") >= F.greatest(F.lit(1), F.col("size") - F.col("most")))
    # The member with fewer differences must share one of even fewer.
    early = 2 * F.col("room") >= F.greatest(F.lit(2), 2 * F.col("size") - F.col("most"))
    keyed = materialize(keyed.select("a", "s", "b", "component", "n", "size", "room", early.alias("early")), "keyed")
    # What stays can share enough with some member of the key, by the sizes that there are.
    fewest = keyed.groupBy("a", "s").agg(F.min(F.when(F.col("early"), F.col("size"))).alias("least"), F.max(F.when(F.col("early"), F.col("n"))).alias("early_n"), F.max("n").alias("most_n"))
    keyed = keyed.join(fewest.where("least IS NOT NULL"), ["a", "s"])
    parts = 100 + percent
    late = 2 * parts * F.col("room") >= parts * (F.col("least") + F.col("size")) - (100 - percent) * (F.col("n") + F.col("early_n"))
    early = F.col("early") & (2 * parts * F.col("room") >= 2 * parts * F.col("size") - (100 - percent) * (F.col("n") + F.col("most_n")))
    keyed = materialize(keyed.select("a", "s", "b", "component", early.cast("int").alias("early"), late.alias("late")).where("early = 1 OR late"), "meeting")
    meets = keyed.groupBy("a", "s").agg(F.count("*").alias("members"), F.max("early").alias("early"), F.min("component").alias("x"), F.max("component").alias("y"))
    meets = meets.where("members > 1 AND early = 1 AND x <> y").select("a", "s", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    rows = keyed.select("a", "s", "b").join(meets, ["a", "s"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("a", "b", "s", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    return rows.join(families.select("a", "b", "component", "n", "d"), ["a", "b"])


def _joined_members(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join components among the members of one block pair."""
    d, at = batch["d"].flatten().to_numpy(zero_copy_only=False), batch["d"].offsets.to_numpy()
    size = np.diff(at)
    value, column, count = np.unique(d, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    held = count[column] > 1
    has = np.zeros((len(size), int((count > 1).sum())), np.float32)
    has[np.repeat(np.arange(len(size)), size)[held], place[column[held]]] = 1
    apart = size[:, None] + size - 2 * (has @ has.T).astype(np.int64)
    n, component = batch["n"].to_numpy(), batch["component"].to_numpy()
    both = n[:, None] + n
    link = (100 * (both - apart) >= percent * (both + apart)) & (component[:, None] != component)
    x, y = np.nonzero(np.triu(link))
    label = np.arange(len(size))
    while (label[x] != label[y]).any():  # to the smallest member reachable
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
    name = batch["b"].to_numpy()
    moved = np.flatnonzero(label != np.arange(len(size)))
    return name[label[moved]], name[moved]


def _links_within(meetings: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members that meet, as few as join their components."""
    key = ["a", "s", "lo", "hi"]

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches(([held] if held else []) + [batch]).combine_chunks().to_batches()[0]
            columns = [held[k].to_numpy() for k in key]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            cuts = [0, *new.tolist()]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield held.slice(i, j - i)
            held = held.slice(cuts[-1])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches):
            if group.num_rows > 1:
                x, y = _joined_members(group, percent)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return meetings.repartition(*key).sortWithinPartitions(*key).select(*key, "b", "component", "n", "d").mapInArrow(run, "a long, b long").distinct()


def _early_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components whose first common
    shingle, rarest first, leaves room for the required overlap."""
    each = sets.select("class", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("class").orderBy("df", "s")
    each = each.join(shared, "s").withColumns({"later": F.count("*").over(Window.partitionBy("class")), "rank": F.row_number().over(order)})
    # Shingles of one set only come first and join with nothing.
    each = each.withColumn("room", F.col("later") - F.col("rank") + 1).where(100 * F.col("room") >= percent * F.col("n"))
    x = each.select("s", F.col("class").alias("a"), F.col("component").alias("p"), F.col("n").alias("n"), F.col("room").alias("i"))
    y = each.select("s", F.col("class").alias("b"), F.col("component").alias("q"), F.col("n").alias("m"), F.col("room").alias("j"))
    enough = (100 + percent) * F.least("i", "j") >= percent * (F.col("n") + F.col("m"))
    return x.join(y, "s").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row (id_col, n_shingles, component_id, kept) per row of ``docs``."""
    docs = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return groups(docs, size, percent, bands, band_rows).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row (ROW, id, n_shingles, component_id, kept) per row of ``docs``
    (ROW, id, text)."""
    docs = docs.select(ROW, "id", "text")
    sig = materialize(_signed(docs, size, bands, band_rows), "signatures")
    # A class is named by the number of its first row.
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", ROW)
    classes = sig.where("n > 0").groupBy("a", "b", "n").agg(F.min(order).alias("first"))
    classes = materialize(classes.select("a", "b", "n", F.col(f"first.{ROW}").alias("class"), "first"), "classes")
    first = sig.select(F.col(ROW).alias("class"), "n", "bands").join(classes.select("class"), "class", "left_semi")
    rows = first.select("class", F.explode("bands").alias("h"))
    buckets = rows.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(rows.join(buckets, "h"), "members")
    ids = members.groupBy("class").agg(F.sum("members").alias("central"))
    sets = materialize(_sets_of(docs.select(F.col(ROW).alias("class"), "text").join(ids.select("class").hint("merge"), "class", "left_semi"), size), "sets")

    left = members.select("h", "class").join(ids, "class")
    links, near = [], []
    for _ in range(ROUNDS):
        hubs = left.groupBy("h").agg(F.count("*").alias("members"), F.max(F.struct("central", (-F.col("class")).alias("class"))).alias("hub")).where("members > 1")
        met = materialize(left.join(hubs.select("h", (-F.col("hub.class")).alias("a")), "h").where(F.col("class") != F.col("a")), "met")
        seen = materialize(_against_hubs(met.select("a", F.col("class").alias("b")).distinct(), sets, percent), "seen")
        links.append(seen.where("linked").select("a", "b"))
        near.append(seen.where("near").select("a", "b", "n", "d"))
        left = materialize(met.join(seen.where("far").select("a", F.col("b").alias("class")), ["a", "class"], "left_semi").select("class", "h", "central"), "left")
    straight = materialize(reduce(DataFrame.union, links), "links")
    found = components(straight)
    names = found.withColumnRenamed("id", "b")
    families = reduce(DataFrame.union, near).join(names, "b", "left").withColumn("component", F.coalesce("component", "b"))
    inner = materialize(_links_within(_meetings(families, percent, BLOCK), percent), "inner")
    found = components(straight.union(inner))

    spans = left.join(found.withColumnRenamed("id", "class"), "class", "left").select("h", "class", F.coalesce("component", "class").alias("component"))
    spans = materialize(spans, "spans")
    open_buckets = spans.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_ids = spans.join(open_buckets, "h", "left_semi").select("class", "component").distinct()
    more = materialize(_confirmed(_early_pairs(sets.join(open_ids, "class"), percent), sets, percent), "more")
    found = components(straight.union(inner).union(more))

    linked = found.select(F.col("id").alias("class"), "component")
    tops = materialize(classes.join(linked, "class").groupBy("component").agg(F.min("first").alias("top")), "tops")
    classes = classes.join(linked.join(tops, "component").select("class", "top"), "class", "left").select("a", "b", "n", F.coalesce("top", "first").alias("top"))
    out = sig.select(ROW, "id", "n", "a", "b").join(classes, ["a", "b", "n"], "left")
    return out.select(ROW, "id", F.col("n").alias("n_shingles"), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("component_id"),
                      F.coalesce(F.col(f"top.{ROW}") == F.col(ROW), F.lit(True)).alias("kept"))
