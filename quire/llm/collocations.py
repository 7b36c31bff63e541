"""Phrase collocation mining by best-first branch-and-bound growth (operator 12).

Texts fold A-Z, split into pieces at punctuation and line ends, and pieces into
words at blanks and tabs.  A candidate is a phrase of two or three words that
stands at least ``LEAST`` times inside pieces of a language.  Cut after its
first k words it scores ``floor(10^6 a^2 / (l r))``, a, l and r being the counts
of the phrase, of the first part and of the rest; the lowest cut counts (of
equal ones the smallest k).  A candidate inside a longer one that is at least
half as frequent (``SHARE`` per cent) is dropped.

Growth, one pass over the texts for each step:

1. Words are counted; those below ``LEAST`` start no phrase.
2. Pairs of frequent words are counted, and scored.
3. The frontier are the pairs u v.  No phrase u v w scores above
   ``10^6 f(u v) / f(u)``, since a <= f(u v) and a <= f(v w): the prefix's counts
   bound all its extensions.  Each language has a level; prefixes whose bound
   reaches it are expanded, and the pairs whose own score reaches it are
   expanded to both sides, which decides whether they are dropped.  All
   surviving phrases at or above the level, ties included, are then known.
4. A language with ``TOP`` of them is settled.  The others lower their level,
   best scores first, so that eight times as many phrases reach it, and expand
   again; a level of 0 expands everything.

The frontier reaches the texts as bit tables of a fixed size, made by Spark
aggregation: a stray bit lets a phrase be counted that need not be, never the
reverse.  Counts are summed in each task before they are shuffled; scores are
decimals of 38 digits, exact for corpora of up to 10^15 words.

Defined cases: null or empty text, or one without words: nothing; a null
language is ``und``; repeated rows count each; words are any other bytes, so
symbols are words, too; tables without candidates give no rows.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words
from quire.session import materialize

TOP = 2000
LEAST = 10
SHARE = 50
SCALE = 1_000_000
#: Scores are told apart by this much when levels are chosen.
STEP = 1000
#: First level: so many times TOP phrases reach it; later ones: so many times more.
FIRST, WIDER = 2, 8
#: Bits of a frontier's table.
BITS = 24
#: Text bytes worked on at once.
CHUNK_BYTES = 1 << 22

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _hashes(column: pa.Array) -> np.ndarray:
    """A hash of every string of a column without nulls."""
    data, at = words.text_bytes(column)
    out = np.full(len(column), 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    out[full] = words.span_hashes(data, at[:-1][full], at[1:][full])
    return out


def _bit_of(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    h = first
    for x in more:
        h = words.mix64(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return (words.mix64(h) >> np.uint64(64 - BITS)).astype(np.int64)


def _has(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def bit_table(phrases: DataFrame, columns: list[str]) -> np.ndarray:
    """The bits of (lang, words) rows as bytes, 2^BITS of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _hashes(batch["lang"])
            parts = [words.mix64(lang + _hashes(batch[c])) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit_of(*parts)))], ["bit"])

    bits = phrases.select("lang", *columns).mapInArrow(run, "bit long")
    from_one = F.col("bit") + 1  # these functions count from 1
    rows = bits.groupBy(F.bitmap_bucket_number(from_one).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(from_one)).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)  # 2 MB, whatever the frontier
    for r in rows:
        at = (r["part"] - 1) * len(r["bits"])
        out[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


class Tokens:
    """The words of a batch: their numbers in ``vocabulary`` (a word of a language), and whether a break follows."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = words.text_bytes(batch["text"])
        start, end = words.word_spans(data, at, WORD)
        self.size = len(start)
        if not self.size:
            return
        length = end - start
        offsets = np.zeros(self.size + 1, np.int32)
        np.cumsum(length, out=offsets[1:])
        said = pa.StringArray.from_buffers(self.size, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[WORD[data]]])).dictionary_encode()
        text = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(start, at)))
        langs = batch["lang"].dictionary_encode()
        lang = langs.indices.to_numpy()[text].astype(np.int64)
        known, self.word = np.unique(lang * len(said.dictionary) + said.indices.to_numpy(), return_inverse=True)
        which, kind = known % len(said.dictionary), known // len(said.dictionary)
        self.vocabulary, self.lang = said.dictionary.take(pa.array(which)), langs.dictionary.take(pa.array(kind))
        self.hash = words.mix64(_hashes(langs.dictionary)[kind] + _hashes(said.dictionary)[which])
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(BREAK[data], out=breaks[1:])
        self.together = (breaks[start[1:]] == breaks[end[:-1]]) & (text[1:] == text[:-1])


def _counted(docs: DataFrame, n: int, tables: tuple[np.ndarray, ...]) -> DataFrame:
    """Counts (lang, w1..wn, f) of the phrases of n words that the tables let
    through; with n = 1 also a row without word, all words of the language."""
    names = [f"w{i + 1}" for i in range(n)]
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def starts(t: Tokens) -> np.ndarray:
        if n == 2:
            ok = _has(sent.value[0], _bit_of(t.hash))[t.word]
            return np.flatnonzero(t.together & ok[:-1] & ok[1:])
        pair = _bit_of(t.hash[t.word[:-1]], t.hash[t.word[1:]])
        prefix, suffix, frequent = (_has(x, pair) & t.together for x in sent.value)
        return np.flatnonzero(prefix[:-1] & frequent[1:] | frequent[:-1] & suffix[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK_BYTES):
                t = Tokens(part)
                if not t.size:
                    continue
                if n == 1:
                    f = np.bincount(t.word, minlength=len(t.vocabulary))
                    yield pa.RecordBatch.from_arrays([t.lang, t.vocabulary, pa.array(f)], ["lang", "w1", "f"])
                    totals = pa.table({"lang": t.lang, "f": f}).group_by("lang").aggregate([("f", "sum")])
                    yield pa.RecordBatch.from_arrays([totals["lang"].combine_chunks(), pa.nulls(len(totals), pa.string()), totals["f_sum"].combine_chunks()], ["lang", "w1", "f"])
                    continue
                at = starts(t)
                if not len(at):
                    continue
                key = t.word[at]
                for k in range(1, n):  # names each prefix, then the prefix with the next word
                    known, first, key, f = np.unique(key * len(t.vocabulary) + t.word[at + k], return_index=True, return_inverse=True, return_counts=True)
                one = at[first]
                columns = [t.vocabulary.take(pa.array(t.word[one + k])) for k in range(n)]
                yield pa.RecordBatch.from_arrays([t.lang.take(pa.array(t.word[one])), *columns, pa.array(f)], ["lang", *names, "f"])

    rows = docs.mapInArrow(run, "lang string, " + ", ".join(f"{x} string" for x in names) + ", f long")
    return rows.groupBy("lang", *names).agg(F.sum("f").alias("f"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)), exactly."""
    wide = [x.cast("decimal(38,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * wide[0] * wide[0], wide[1] * wide[2])


def _pairs(docs: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """Pairs (lang, w1, w2, f, f1, f2, score, bound) of frequent words."""
    found = materialize(_counted(docs, 2, (bit_table(frequent, ["w1"]),)).where(F.col("f") >= least), "pairs")
    out = found.join(frequent.select("lang", "w1", F.col("f").alias("f1")), ["lang", "w1"])
    out = out.join(frequent.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2")), ["lang", "w2"])
    bound = F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * F.col("f").cast("decimal(38,0)"), F.col("f1").cast("decimal(38,0)"))
    return materialize(out.select("lang", "w1", "w2", "f", "f1", "f2", score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"), bound.alias("bound")), "scored")


def _triples(docs: DataFrame, pairs: DataFrame, levels: DataFrame, least: int) -> DataFrame:
    """All candidates of three words that extend a pair whose bound reaches
    the level, or hold a pair whose score does (and some more), scored:
    (lang, w1, w2, w3, f, l, r, score)."""
    at = pairs.join(levels, "lang")
    tables = tuple(bit_table(x, ["w1", "w2"]) for x in (at.where("bound >= level"), at.where("score >= level"), at))
    found = materialize(_counted(docs.join(levels, "lang", "left_semi"), 3, tables).where(F.col("f") >= least), "triples")
    found = found.join(pairs.select("lang", "w1", "w2", F.col("f").alias("f12"), "f1"), ["lang", "w1", "w2"])
    found = found.join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"), F.col("f2").alias("f3")), ["lang", "w2", "w3"])
    found = found.withColumns({"s1": score(F.col("f"), F.col("f1"), F.col("f23")), "s2": score(F.col("f"), F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    return materialize(found.select("lang", "w1", "w2", "w3", "f", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                                    F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score")), "grown")


def _levels(scores: DataFrame, wanted: int, before: DataFrame | None) -> DataFrame:
    """(lang, level): the highest multiple of STEP that ``wanted`` scores of
    the language reach, but lower than before; 0 if there are not so many."""
    steps = scores.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).agg(F.count("*").alias("n"))
    reach = steps.withColumn("reach", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step"))))
    found = reach.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reach") >= wanted, F.col("step"))), F.lit(0)).alias("step"))
    out = found.select("lang", (F.col("step") * STEP).alias("level"))
    if before is not None:
        out = out.join(before.withColumnRenamed("level", "was"), "lang").select("lang", F.greatest(F.lit(0), F.least("level", F.col("was") - STEP)).alias("level"))
    return materialize(out, "levels")


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row (lang, rank, phrase, a, l, r, n, score) per phrase among the
    first ``top`` of its language."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    counts = materialize(_counted(docs, 1, ()).where((F.col("f") >= least) | F.col("w1").isNull()), "words")
    totals = counts.where("w1 IS NULL").select("lang", F.col("f").alias("n"))
    pairs = _pairs(docs, counts.where("w1 IS NOT NULL"), least)

    known = pairs.select("lang", "score")
    levels, wanted, settled = _levels(known, FIRST * top, None), FIRST * top, []
    while not levels.isEmpty():
        triples = _triples(docs, pairs, levels, least)
        longer = triples.select("lang", "w1", "w2", "f").union(triples.select("lang", "w2", "w3", "f")).groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
        judged = pairs.join(levels, "lang").join(longer, ["lang", "w1", "w2"], "left")
        judged = judged.where(~F.coalesce(100 * F.col("longer") >= share * F.col("f"), F.lit(False)))
        phrases = judged.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score", "level")
        phrases = phrases.union(triples.join(levels, "lang").select("lang", F.concat_ws(" ", "w1", "w2", "w3"), "f", "l", "r", "score", "level"))
        phrases = materialize(phrases, "phrases")
        alive = phrases.where("score >= level")
        enough = alive.groupBy("lang").agg(F.count("*").alias("alive"))
        open_levels = materialize(levels.join(enough, "lang", "left").where((F.coalesce("alive", F.lit(0)) < top) & (F.col("level") > 0)).select("lang", "level"), "open")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        done = alive.join(open_levels, "lang", "left_anti").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
        settled.append(materialize(done.drop("level"), "settled"))
        wanted *= WIDER
        levels = _levels(phrases.join(open_levels, "lang", "left_semi").select("lang", "score"), wanted, open_levels)
    out = settled[0] if settled else pairs.where("false").select("lang", F.lit("").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score", F.col("f").alias("rank"))
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
