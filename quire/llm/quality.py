"""Quality classifier: weak-label model and hashed linear scorer (operator 5).

No labels are read.  Eight overlapping heuristic labellers vote `good`, `bad`
or nothing on every document.  Expectation-maximisation over the counts of all
vote patterns (at most 3^8, whatever the corpus) estimates each labeller's
votes given the hidden class - good, or one of several kinds of bad - and with
them its accuracy and the posterior of every pattern.
Posterior labels of a bounded sample (``SAMPLE`` documents of each side, the
first by a hash of their id) train a logistic linear scorer on hashed features
of the whole text: trigrams of byte classes and word shapes.  The scorer, not
the votes, decides; only of texts too short to show anything (``FROM_CHARS``)
the share of good texts does.

Defined cases: a null text or one without words has score 0 and is rejected;
repeated rows get a row each; a null id is like any other.  With no documents
to train on, every text with words has its posterior (or 0.5) as score and is
kept.  Other columns are not read.  Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.session import materialize

#: Training documents of each side.
SAMPLE = 2048
#: Columns of the hashed features.
WIDTH = 2048
RIDGE = 3e-4
KEEP = 0.4
#: Texts of fewer units show too little to learn from.  A unit is a word; a run without white space of more than RUN bytes is cut into units of UNIT bytes.
FEW = 5
RUN, UNIT = 48, 6
#: A text of fewer than FEW units has the share of good texts as score up to the first number of characters (white space not
#: counted) and the scorer's from the second on; in between its log odds go from the one to the other.
FROM_CHARS, FULL_CHARS = 6, 32

#: Byte classes of the trigrams: letters, digits and white space each as one, other ASCII as itself.
_class = np.arange(256, dtype=np.uint32)
_class[97:123] = _class[128:] = 1
_class[65:91] = 2
_class[48:58] = 3
_class[[9, 11, 12, 13, 32]] = 4
_letter = np.zeros(256, bool)
_letter[97:123] = _letter[65:91] = _letter[128:] = True
#: Punctuation of ordinary prose.
_plain = np.zeros(256, bool)
_plain[[ord(c) for c in ".,;:'\"()-?"]] = True
_symbol = np.zeros(256, bool)
_symbol[33:127] = True
_symbol &= ~_letter & ~_plain
_symbol[48:58] = False


@dataclass
class Texts:
    """What labellers and features read of a batch of texts."""
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    again: np.ndarray
    """Words equal to the word before in the text."""
    distinct: np.ndarray
    """Number of distinct words of each text."""
    cut: np.ndarray
    """Where units begin within a run without white space."""


def _units(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, with those of more than RUN bytes cut into units."""
    parts = np.where(end - start > RUN, -(-(end - start) // UNIT), 1)
    if (parts == 1).all():
        return start, end
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut, last = np.repeat(start, parts) + inner * UNIT, np.repeat(end, parts)
    return cut, np.where(np.repeat(parts, parts) > 1, np.minimum(cut + UNIT, last), last)


def characters(t: Texts) -> np.ndarray:
    """Characters of each text that are not white space."""
    return _sums(words.NOT_SPACE[t.data] & ((t.data & 0xC0) != 0x80), t.at)


def read(column: pa.Array) -> Texts:
    data, at = words.text_bytes(column)
    start, end = _units(*words.word_spans(data, at, words.NOT_SPACE))
    first = np.searchsorted(start, at)
    h = words.span_hashes(data, start, end)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    distinct = np.array([len(np.unique(h[i:j])) for i, j in zip(first[:-1], first[1:], strict=True)], np.int64)
    inside = start[1:][start[1:] == end[:-1]]
    return Texts(data, at, start, end, first, again, distinct, inside[~np.isin(inside, at)])


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags in each span between two entries of ``at``."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _vote(x: np.ndarray, good, bad) -> np.ndarray:
    """2 where good, 1 where bad, else 0."""
    return np.where(bad(x), 1, np.where(good(x), 2, 0))


#: The labellers' names, in the order of the pattern's digits to base 3.
LABELLERS = ("symbols", "capitals", "repeats", "lone symbols", "vocabulary", "short words", "odd endings", "sentences")


def votes(t: Texts) -> np.ndarray:
    """(texts, labellers): 0 abstains, 1 votes bad, 2 votes good."""
    n = np.diff(t.first)
    per_word = np.maximum(n, 1)
    letters = _sums(_letter[t.data], t.at)
    length = t.end - t.start
    has_letter = np.concatenate([[0], np.cumsum(_letter[t.data])])
    inner = (t.data >= 65) & (t.data < 91)
    inner[1:] &= _letter[t.data[:-1]]  # capitals within a word
    lone = has_letter[t.end] == has_letter[t.start]
    digits = (t.data[t.end - 1] >= 48) & (t.data[t.end - 1] < 58) if len(t.end) else np.zeros(0, bool)
    last = t.data[t.end - 1] if len(t.end) else np.zeros(0, np.uint8)
    measures = (
        (_sums(_symbol[t.data], t.at) / per_word, lambda x: x < 0.15, lambda x: (x > 0.5) & (n >= 5)),
        (_sums(inner, t.at) / np.maximum(letters, 1), lambda x: x < 0.1, lambda x: (x > 0.3) & (n >= 3)),
        (_sums(t.again, t.first) / per_word, lambda x: x < 0.05, lambda x: (x > 0.25) & (n >= 5)),
        (_sums(lone & ~digits, t.first) / per_word, lambda x: x < 0.05, lambda x: x > 0.2),
        (t.distinct / per_word, lambda x: x > 0.3, lambda x: (x < 0.2) & (n >= 50) & (n < 2000)),
        (_sums((length <= 3) & ~lone, t.first) / per_word, lambda x: x > 0.15, lambda x: (x < 0.06) & (n >= 20)),
        (_sums(_symbol[last], t.first) / per_word, lambda x: x < 0.1, lambda x: (x > 0.3) & (n >= 5)),
        (_sums(last == ord("."), t.first) / per_word, lambda x: (x > 0.02) & (x < 0.5), lambda x: (x < 0.005) & (n >= 50)),
    )
    out = np.stack([_vote(x, good, bad) for x, good, bad in measures], 1)
    out[n == 0] = 0
    return out


def features(t: Texts) -> np.ndarray:
    """(texts, WIDTH) hashed counts, square roots taken, rows of length 1."""
    n = len(t.at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    for i in range(n):
        for lo in range(int(t.at[i]), int(t.at[i + 1]), words.PIECE_BYTES):
            hi = min(lo + words.PIECE_BYTES + 2, int(t.at[i + 1]))
            c = _class[t.data[lo:hi]]
            within = t.cut[slice(*np.searchsorted(t.cut, (lo + 1, hi)))]
            if len(within):  # units read like words
                c = np.insert(c, within - lo, _class[32])
            gram = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
            out[i] += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - WIDTH.bit_length() + 1), minlength=WIDTH)
        # Word shapes, as often as there are words: length, last class, equal to the word before.
        w = slice(t.first[i], t.first[i + 1])
        length = np.minimum(t.end[w] - t.start[w], 15).astype(np.uint32)
        shape = (np.uint32(1) << np.uint32(24)) | (length << np.uint32(12)) | (_class[t.data[t.end[w] - 1]] << np.uint32(1)) | t.again[w]
        out[i] += np.bincount((shape * np.uint32(0x85EBCA6B)) >> np.uint32(32 - WIDTH.bit_length() + 1), minlength=WIDTH)
        said = np.uint32(1 << 25) | t.again[w]
        out[i] += np.bincount((said * np.uint32(0xC2B2AE35)) >> np.uint32(32 - WIDTH.bit_length() + 1), minlength=WIDTH)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


@dataclass
class WeakLabels:
    """Class 0 is good; each other class is a kind of bad text, begun from the
    texts in which one labeller's symptom comes with another's."""
    share: np.ndarray
    """Share of each class."""
    given: np.ndarray
    """(labellers, classes, 3 votes) probabilities."""

    @property
    def prior(self) -> float:
        return float(self.share[0])

    def accuracy(self) -> np.ndarray:
        """(labellers, 2): share of right votes among those on good and on bad texts."""
        bad = (self.given[:, 1:] * self.share[1:, None]).sum(1) / max(1e-12, self.share[1:].sum())
        return np.stack([self.given[:, 0, 2] / (1 - self.given[:, 0, 0]), bad[:, 1] / (1 - bad[:, 0])], 1)

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """(patterns, classes) posterior."""
        log = np.log(self.share) + sum(np.log(self.given[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.classes(patterns)[:, 0]


def digits(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakLabels:
    """Expectation-maximisation.  It starts from two symptoms making a bad text
    and one alone being a slip."""
    symptom = patterns == 1
    n = symptom.sum(1)
    good = np.array([0.98, 0.9, 0.1])[np.minimum(n, 2)]
    kinds = np.where(n[:, None] >= 2, symptom, True)
    p = np.concatenate([good[:, None], (1 - good)[:, None] * kinds / kinds.sum(1, keepdims=True)], 1)
    for _ in range(rounds):
        weight = (p * counts[:, None]).T
        given = np.stack([np.stack([(weight * (patterns[:, j] == v)).sum(1) for v in range(3)], 1) for j in range(patterns.shape[1])]) + 0.1
        share = np.maximum(weight.sum(1) / counts.sum(), 1e-6)
        model = WeakLabels(share / share.sum(), given / given.sum(2, keepdims=True))
        before, p = p, model.classes(patterns)
        if np.abs(p - before).max() < 1e-9:
            break
    return model


def train_scorer(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 8) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression on
    soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * len(x) * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _voted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                t = read(part["text"])
                pattern = votes(t) @ 3 ** np.arange(len(LABELLERS))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.where(np.diff(t.first) >= FEW, pattern, -1))], ["id", "pattern"])

    return docs.select("id", "text").mapInArrow(run, "id long, pattern long")


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                t = read(part["text"])
                x = features(t).astype(np.float16)
                pattern = votes(t) @ 3 ** np.arange(len(LABELLERS))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(pattern), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "pattern", "x"])

    return docs.select("id", "text").mapInArrow(run, "id long, pattern long, x binary")


@dataclass
class Model:
    labels: WeakLabels | None
    scorer: np.ndarray | None


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: (id, text)."""
    voted = materialize(_voted(docs), "votes").where("pattern >= 0")
    counted = voted.groupBy("pattern").count().collect()  # 3^8 patterns at most
    if not counted:
        return Model(None, None)
    counted.sort()
    pattern = np.array([r["pattern"] for r in counted])
    labels = estimate(digits(pattern), np.array([r["count"] for r in counted], float))
    good = [int(p) for p, q in zip(pattern, labels.posterior(digits(pattern)), strict=True) if q >= 0.5]
    side = F.col("pattern").isin(good) if good else F.lit(False)
    named = voted.where("id is not null")
    ids = named.where(side).orderBy(F.xxhash64("id"), "id").limit(sample).union(named.where(~side).orderBy(F.xxhash64("id"), "id").limit(sample)).select("id").distinct()
    # 2 x SAMPLE ids: sent to the texts, so that no text moves.
    rows = sorted(_featured(docs.join(F.broadcast(ids), "id", "left_semi")).collect())[: 4 * sample]  # 2 x SAMPLE rows, but for repeated ids
    if not rows:
        return Model(labels, None)
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(len(rows), WIDTH).astype(np.float32)
    return Model(labels, train_scorer(x, labels.posterior(digits(np.array([r["pattern"] for r in rows])))))


def _log_odds(p):
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def judge(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of the votes, score, kept) of every text."""
    t = read(column)
    some = np.diff(t.first) > 0
    weak = model.labels.posterior(votes(t)) if model.labels else np.full(len(some), 0.5)
    p = weak
    if model.scorer is not None:
        p = 1 / (1 + np.exp(-np.clip(features(t) @ model.scorer[:-1] + model.scorer[-1], -30, 30)))
    few, prior = np.diff(t.first) < FEW, model.labels.prior if model.labels else 0.5
    weak = np.where(few, prior, weak)
    if model.scorer is None:
        p = weak
    else:
        trust = np.where(few, np.clip((characters(t) - FROM_CHARS) / (FULL_CHARS - FROM_CHARS), 0, 1), 1)
        odds = _log_odds(prior) + trust * (_log_odds(p) - _log_odds(prior))
        p = np.where(trust < 1, 1 / (1 + np.exp(-odds)), p)
    p = np.where(some, p, 0.0)
    return weak, p, (p >= KEEP) & some


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row (id, weak_label, score, kept) per row of ``docs`` (id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                weak, p, kept = judge(sent.value, part["text"])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(weak), pa.array(p), pa.array(kept)], ["id", "weak_label", "score", "kept"])

    return docs.select("id", "text").mapInArrow(run, "id long, weak_label double, score double, kept boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row (id_col, weak_label, score, kept) per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return score(rows, train(rows, sample)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are;
    texts are filtered where they are read, without a join."""
    model = train(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, text_col):
                yield part.filter(pa.array(judge(sent.value, part[text_col])[2]))

    return docs.mapInArrow(run, docs.schema)
