"""Benchmark decontamination over a positional inverted index (operator 3).

``build_index`` turns training texts into segments of a couple of megabytes of
text: per segment the sorted 64-bit term hashes, their counts, and for each
term the ascending word positions (stored as differences, compressed), plus
the segment's document ids and first positions.  Segments are independent, so
building, storing and searching them needs no shuffle of postings.

``search`` slices benchmark texts into windows of consecutive words and looks
for them in every segment: windows with a term that the segment lacks drop
out; the others start from the postings of their rarest term there, shifted by
the term's offset, and are intersected with the other terms' postings, rarer
first.  A start that survives with all terms in place is an exact phrase match;
one whose terms all lie within ``slack`` words of their place is a proximity
match.  The windows are the stated query set: they go to the segments in blocks
of ``BLOCK`` windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z.  Two terms are
told apart by 64-bit hashes (10^10 distinct terms against 10^5 benchmark terms
collide anywhere with a probability near 10^-4).

Defined cases: null or empty texts have no words and are never hit; a benchmark
item without words has no window; an item id that is null is named `null`;
repeated documents give a row each, repeated items count once.  Other columns
are not read.  An empty benchmark hits nothing; no documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.session import materialize, shared_dir

WINDOW = 10
SLACK = 2
BLOCK = 1 << 16
#: Candidate starts tested at once inside a task.
STARTS = 1 << 19
INDEX = "segment long, ids array<long>, first array<long>, terms binary, counts binary, steps binary"


def postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, positions by term) of a run of word hashes."""
    bits = max(1, int(len(h)).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low
    sorted_h = h[order]
    head = np.ones(len(h), bool)
    head[1:] = sorted_h[1:] != sorted_h[:-1]
    terms = sorted_h[head]
    if (terms[1:] <= terms[:-1]).any():  # two terms differ in the low bits alone
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        head[1:] = sorted_h[1:] != sorted_h[:-1]
        terms = sorted_h[head]
    return terms, np.diff(np.append(np.flatnonzero(head), len(h))).astype(np.uint32), order.astype(np.uint32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs`` as a stored table, one row per segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.chunks(batch, "text"):
                h, first = words.words(part["text"], words.ALNUM)
                terms, counts, order = postings(h)
                steps = np.diff(order, prepend=np.uint32(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment]), pa.ListArray.from_arrays([0, part.num_rows], part["id"]), pa.array([first], pa.list_(pa.int64())),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts, steps))], ["segment", "ids", "first", "terms", "counts", "steps"])
                segment += 1

    spark = docs.sparkSession
    path = shared_dir(spark, "postings")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)
    # Rows of megabytes: few to a file, so that no reader holds many at once.
    rows.write.option("maxRecordsPerFile", 8).option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, terms) of all items; terms are the hashes in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                h, first = words.words(part["text"], words.ALNUM)
                n = np.diff(first)
                item, terms = [], []
                names = part["item"].to_pylist()
                for i in np.flatnonzero(n):
                    own = h[first[i]:first[i + 1]].view(np.int64)
                    for k in range(max(1, len(own) - size + 1)):
                        item.append(names[i])
                        terms.append(own[k:k + size])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "item string, terms array<long>").distinct()


def _member(keys: np.ndarray, term: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
    """Whether ``keys`` (term << 32 | position, ascending) has an entry of the
    term within ``slack`` of position ``at``."""
    low = (term << 32) + np.maximum(at - slack, 0)
    i = np.searchsorted(keys, low)
    found = keys[np.minimum(i, len(keys) - 1)]
    return (i < len(keys)) & (found <= (term << 32) + at + slack) & (at + slack >= 0)


def match(segment: dict, query: np.ndarray, distinct: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) of all matches in one segment.  ``query`` holds
    the windows' terms as indexes into ``distinct`` (ascending hashes), -1 where
    a window is shorter."""
    terms = np.frombuffer(segment["terms"], np.uint64)
    if not len(terms):
        return
    counts = np.frombuffer(segment["counts"], np.uint32).astype(np.int64)
    place = np.minimum(np.searchsorted(terms, distinct), len(terms) - 1)
    have = terms[place] == distinct
    rarity = np.where(query >= 0, np.where(have, counts[place], 0)[query], np.iinfo(np.int64).max)
    live = np.flatnonzero(rarity.min(1) > 0)  # every term occurs
    if not len(live):
        return
    positions = np.cumsum(np.frombuffer(segment["steps"], np.uint32), dtype=np.uint32).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    used = np.unique(query[live][query[live] >= 0])
    take = counts[place[used]]
    inner = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    keys = (np.repeat(used, take) << 32) | positions[np.repeat(begin[place[used]], take) + inner]
    keys_at = np.zeros(len(distinct) + 1, np.int64)
    keys_at[1:][used] = take
    keys_at = np.cumsum(keys_at)
    order = np.argsort(rarity[live], 1, kind="stable")
    rarest = order[:, 0]
    lead = query[live, rarest]
    n = counts[place[lead]]
    ends = np.cumsum(n)
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STARTS, "right")))
        n_here = n[i:j]
        w = np.repeat(np.arange(i, j), n_here)
        inner = np.arange(n_here.sum()) - np.repeat(np.cumsum(n_here) - n_here, n_here)
        start = (keys[keys_at[lead[w]] + inner] & 0xFFFFFFFF) - rarest[w]
        exact = start >= 0
        for k in range(1, query.shape[1]):
            if not len(w):
                break
            offset = order[w, k]
            term = query[live[w], offset]
            beyond = term < 0
            near = beyond | _member(keys, np.maximum(term, 0), start + offset, slack)
            exact &= beyond | _member(keys, np.maximum(term, 0), start + offset, 0)
            w, start, exact = w[near], start[near], exact[near]
        yield live[w], start, exact
        i = j


def _hits(index: DataFrame, block: list, slack: int) -> DataFrame:
    names = sorted({item for item, _ in block})
    code = {name: i for i, name in enumerate(names)}
    longest = max((len(t) for _, t in block), default=1)
    hashes = np.full((len(block), longest), 0, np.int64)
    size = np.array([len(t) for _, t in block], np.int64)
    for i, (_, t) in enumerate(block):
        hashes[i, : len(t)] = t
    inside = np.arange(longest) < size[:, None]
    distinct = np.unique(hashes.view(np.uint64)[inside])
    query = np.where(inside, np.searchsorted(distinct, hashes.view(np.uint64)), -1)
    item = np.array([code[name] for name, _ in block], np.int64)
    sent = index.sparkSession.sparkContext.broadcast((names, item, query, size, distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, query, size, distinct = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment = {c: batch[c][row].as_buffer() for c in ("terms", "counts", "steps")}
                first = batch["first"][row].values.to_numpy()
                ids = batch["ids"][row].values
                total = int(first[-1])
                cover = np.zeros(total + 1, np.int64)
                pairs, near_pairs = [], []
                for w, start, exact in match(segment, query, distinct, slack):
                    doc = np.searchsorted(first, np.maximum(start, 0), "right") - 1
                    whole = (start >= 0) & (start + size[w] <= first[np.minimum(doc + 1, len(first) - 1)])
                    # A proximity match may begin before the text does; it counts where its middle lies.
                    middle = np.clip(start + size[w] // 2, 0, total - 1)
                    near_pairs.append(np.unique((np.searchsorted(first, middle, "right") - 1) * len(names) + item[w]))
                    exact &= whole
                    np.add.at(cover, start[exact], 1)
                    np.add.at(cover, start[exact] + size[w[exact]], -1)
                    pairs.append(np.unique(doc[exact] * len(names) + item[w[exact]]))
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                near = np.setdiff1d(np.concatenate(near_pairs), pair) if near_pairs else np.zeros(0, np.int64)
                edge = np.arange(len(ids) + 1)
                lists = [pa.ListArray.from_arrays(np.searchsorted(hit, first).astype(np.int32), pa.array(hit))]
                for p in (pair, near):
                    lists.append(pa.ListArray.from_arrays(np.searchsorted(p, edge * len(names)).astype(np.int32), pa.array([names[x] for x in p % max(1, len(names))], pa.string())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), batch["segment"][row].as_py())), pa.array(edge[:-1]), ids, pa.array(np.diff(first)), *lists],
                    ["segment", "ordinal", "id", "n_words", "hit", "items", "near"])

    return index.mapInArrow(run, "segment long, ordinal long, id long, n_words long, hit array<long>, items array<string>, near array<string>")


def search(index: DataFrame, query: DataFrame, slack: int = SLACK, block: int = BLOCK) -> DataFrame:
    """One row per indexed document: n_words, n_hit, items (exact phrase
    matches) and near_items (proximity matches only)."""
    found, part = None, []
    rows = materialize(query, "windows").toLocalIterator()
    for row in rows:
        part.append((row["item"], row["terms"]))
        if len(part) == block:
            hits = _hits(index, part, slack)
            found, part = hits if found is None else found.union(hits), []
    if part or found is None:
        hits = _hits(index, part, slack)
        found = hits if found is None else found.union(hits)
    docs = found.groupBy("segment", "ordinal").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return docs.select("id", "n_words", "n_hit", "items", F.array_sort(F.array_except("near", "items")).alias("near_items"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_hit, items, near_items."""
    return search(build_index(docs, id_col, text_col), windows(items, size), slack).withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The matches of ``decontaminate`` with the items as count and checksum."""
    return found.select("*", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
