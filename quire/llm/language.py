"""Language identification by string kernels (operator 8).

Two texts are compared by the byte n-grams (n = 1, 2, 3) that both contain,
wherever and however often: a blended-spectrum presence kernel, normalised to 1
for a text with itself.  Letters are folded (A-Z) and every other ASCII byte
counts as a space; n-grams are hashed into ``WIDTHS`` columns.  Some training
texts of each language are Nystroem landmarks; one-versus-rest kernel ridge
regression on the landmark features gives a weight per landmark and language.
Scoring is two matrix products per batch: presence x landmarks, kernel x weights.

Training uses ``PER_LANGUAGE`` documents of each language at most (the first by
a hash of their id) and ``LANDMARKS`` of them as landmarks; these bounds are
the model's size.  Only documents whose crc32(id as text) mod 3 is not 1 and
whose text and language are not null are learned from; predictions read texts
only.

The filter does not use the scores, which always sum to nearly the same and so
cannot reject: a text is in none of the languages if the learned texts of its
best language contain too few of its n-grams.  The limit comes from the learned
texts, each held against the others.

Defined cases: a null text or one without a letter is `und` with score 0, as is
everything if there is nothing to learn from.  Equal scores: the first language
in order of name.  A null id counts as not held out and is not learned from;
repeated rows get a row each.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words

#: Columns of the 1-, 2- and 3-grams.
WIDTHS = (256, 4096, 8192)
PER_LANGUAGE = 256
LANDMARKS = 24
RIDGE = 1e-3
#: Texts of one matrix product.
ROWS = 256
UNKNOWN = "und"
#: The filter's limit: this share of the coverage that all but ``QUANTILE`` of the learned texts reach.
SLACK, QUANTILE = 0.75, 0.01

_letter = np.zeros(256, np.uint32)
_letter[97:123] = _letter[65:91] = np.arange(1, 27)
_letter[128:] = np.arange(27, 155)


def presence(column: pa.Array) -> np.ndarray:
    """(texts, columns) 0/1 matrix of the n-grams that each text contains."""
    data, at = words.text_bytes(column)
    n, width = len(column), sum(WIDTHS)
    out = np.zeros(n * width, np.float32)
    for first in range(n):  # a text at a time, long ones in pieces that overlap by two bytes
        for lo in range(int(at[first]), int(at[first + 1]), words.PIECE_BYTES):
            code = _letter[data[lo:min(lo + words.PIECE_BYTES + 2, int(at[first + 1]))]]
            base, gram = first * width, np.zeros(len(code), np.uint32)
            for k, size in enumerate(WIDTHS):
                gram = gram[: len(code) - k] * np.uint32(155) + code[k:]
                out[base + (gram if k == 0 else (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(size).bit_length() + 1))] = 1
                base += size
    return out.reshape(n, width)


def unit_rows(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))  # 0/1 entries: the sum is the squared length


def _coverage(p: np.ndarray, known: np.ndarray, label: np.ndarray) -> np.ndarray:
    return (p @ known.astype(np.float32))[np.arange(len(p)), label] / np.maximum(p.sum(1), 1)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    """(columns, landmarks): normalised presence."""
    weights: np.ndarray
    """(landmarks, languages)."""
    grams: np.ndarray
    """(columns, languages): learned texts of the language that contain the n-gram, 2 standing for more."""
    least: float
    """Coverage below which a text is in none of the languages."""

    def covered(self, p: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams that learned texts of its language contain."""
        return _coverage(p, self.grams > 0, best)

    def scores(self, p: np.ndarray) -> np.ndarray:
        return (unit_rows(p) @ self.landmarks) @ self.weights


def fit(p: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of the rows of ``p`` and their languages."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == i)[:landmarks] for i in range(len(names))])
    unit = unit_rows(p).astype(np.float64)
    z = unit[chosen]
    value, vector = np.linalg.eigh(z @ z.T)
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    features = unit @ z.T @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    inner = features.T @ features + ridge * len(p) * np.eye(features.shape[1])
    grams = np.stack([np.minimum(p[label == i].sum(0), 2) for i in range(len(names))], 1).astype(np.uint8)
    # An n-gram of a learned text counts as covered if another text of its language contains it.
    least = SLACK * float(np.quantile(_coverage(p, grams > 1, label), QUANTILE))
    return Model(names, z.T.astype(np.float32), (root @ np.linalg.solve(inner, features.T @ target)).astype(np.float32), grams, least)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model learned from the documents that are not held out."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id") & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = usable.select("id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                bits = np.packbits(presence(part["text"]).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part["id"], part["lang"], pa.array([x.tobytes() for x in bits], pa.binary())], ["id", "lang", "bits"])

    # PER_LANGUAGE ids of each language: sent to the texts, so that no text moves.
    sample = usable.join(F.broadcast(ids), "id", "left_semi").select("id", "lang", "text").mapInArrow(run, "id long, lang string, bits binary")
    rows = sorted(sample.collect(), key=lambda r: (r["lang"], r["id"], r["bits"]))  # languages x PER_LANGUAGE small rows
    if not rows:
        return None
    p = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : sum(WIDTHS)]
    return fit(p.astype(np.float32), [r["lang"] for r in rows], landmarks)


def recognise(model: Model | None, column: pa.Array, lettered: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of every text; ``lettered`` says which have letters."""
    named = lettered.to_numpy(zero_copy_only=False)
    if model is None:
        return [UNKNOWN] * len(named), np.zeros(len(named))
    s = model.scores(presence(column))
    said = [model.languages[b] if ok else UNKNOWN for b, ok in zip(s.argmax(1), named, strict=True)]
    return said, np.where(named, np.clip((s.max(1) + 1) / 2, 0, 1), 0.0).astype(np.float64)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, held_out, lang_pred, score) per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch, "text"):
                for i in range(0, chunk.num_rows, ROWS):
                    part = chunk.slice(i, ROWS)
                    said, score = recognise(sent.value, part["text"], part["lettered"])
                    yield pa.RecordBatch.from_arrays([part["id"], part["held_out"], pa.array(said, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), lettered.alias("lettered"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` with the model trained on ``docs``."""
    return predict(docs, train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)


def keep_known(docs: DataFrame, least: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in a learned language, all columns as they are: the
    best language's learned texts contain ``least`` (or the model's limit) of
    the text's n-grams.  With nothing to learn from, every row with a letter."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch, text_col):
                for i in range(0, chunk.num_rows, ROWS):
                    part = chunk.slice(i, ROWS)
                    if sent.value is None:
                        yield part
                    else:
                        p = presence(part[text_col])
                        covered = sent.value.covered(p, sent.value.scores(p).argmax(1))
                        yield part.filter(pa.array(covered >= (sent.value.least if least is None else least)))

    return docs.where(F.col(text_col).rlike(r"\p{L}")).mapInArrow(run, docs.schema)
