"""SentencePiece encoding and decoding by batched Viterbi (operator 2).

A text becomes words: a run of spaces (as U+2581) with the characters after it.
No piece holds U+2581 after another character, so words are encoded apart, and
each distinct word once: a Python worker remembers the words it has encoded.  Words of equal length advance together:
for every end position and piece length, the hashes of one substring per word
are probed in the sorted piece keys, and the best way to reach the position is
kept as a backpointer.

What is best depends on the model.  A unigram model takes the largest sum of
scores.  A BPE model has no sum to maximise; its encoding is the one sequence
in which every two neighbours would also be encoded as themselves side by
side.  So a piece is admitted after the last piece of the best way to its start
only if the two are such a pair, at most one is, and the same backpointers hold
the result.  Whether two pieces are such a pair is decided by undoing their
merges in order of rank until a merge across their border would have come first.

Ids equal the sentencepiece library's for models without text normalisation and
with a dummy prefix, such as the public 32k BPE model; ``load`` refuses others.

Defined cases: null text gives null ids, the empty text no ids; characters
without a piece become byte pieces.  Decoding restores the text, but for U+2581
in it, which decodes as a space, as in the library.  Ids that spell no valid
UTF-8 decode with U+FFFD.  Repeated rows, ties: a row each.  Other columns are
not read.  Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.words import BASE, mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Slots of the table of decided pairs.
SLOTS = 1 << 20
#: Words beyond this many characters (encoded data, mostly) are walked one by one.
LONG = 200
#: Encoded words that a Python worker remembers; beyond it, it forgets all.
REMEMBERED = 1 << 20
_POINT = mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED27))
_UP, _DOWN = words._powers(words.PIECE_BYTES)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _finish(raw: np.ndarray, length) -> np.ndarray:
    return mix64(raw + np.asarray(length, np.uint64))


@dataclass
class Model:
    bpe: bool
    strings: list[bytes]
    """Bytes that each id decodes to."""
    keys: np.ndarray
    ids: np.ndarray
    """Hashes of the matched pieces, ascending, and their ids."""
    score: np.ndarray
    rank: np.ndarray
    """Order of merging; -1 for single characters."""
    raw: np.ndarray
    length: np.ndarray
    split: np.ndarray
    """(ids, 2): the two pieces that merge last into each; -1 for characters."""
    reached: np.ndarray
    """Whether a piece's own string is encoded as that piece."""
    byte: np.ndarray
    """Id of each byte piece."""
    longest: int
    present: np.ndarray
    """Whether any piece's hash has these top 20 bits."""
    seen: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    """Hashes of the remembered words, ascending."""
    place: np.ndarray = field(default_factory=lambda: np.zeros((2, 0), np.int64))
    """Where in the pool each one's tokens begin, and how many they are."""
    pool: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, or -1."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.present[h >> np.uint64(44)])  # most substrings are ruled out by their top bits
        i = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[i] == h[maybe], self.ids[i], -1)
        return out


@lru_cache(1)
def load(path: str = MODEL) -> Model:
    """The model file's pieces as lookup tables."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "Ａ ﬁ  ① x "
    if sp.normalize(probe) != SPACE_TEXT + probe.replace(" ", SPACE_TEXT):
        raise ValueError(f"{path}: models that normalise texts, or without a dummy prefix, are not supported")
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)])
    plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)])
    if any(SPACE_TEXT in p.lstrip(SPACE_TEXT) or (p.startswith(2 * SPACE_TEXT) and p.strip(SPACE_TEXT)) for p, ok in zip(names, plain, strict=True) if ok):
        raise ValueError(f"{path}: pieces across words are not supported")
    byte = np.full(256, sp.unk_id(), np.int64)
    strings = []
    for i, p in enumerate(names):
        if sp.is_byte(i):
            byte[int(p[3:5], 16)] = i
            strings.append(bytes([int(p[3:5], 16)]))
        else:
            strings.append(b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE_TEXT, " ").encode())
    length = np.array([len(p) for p in names])
    raw = np.array([np.sum(_POINT[_points(p)] * _UP[: len(p)], dtype=np.uint64) for p in names], np.uint64)
    chosen = np.flatnonzero(plain)
    keys = _finish(raw[chosen], length[chosen])
    order = np.argsort(keys)
    merged = plain & (length > 1)
    bpe = bool((score[merged] == np.rint(score[merged])).all())
    rank = np.full(n, -1)
    rank[chosen[np.argsort(-score[chosen], kind="stable")]] = np.arange(len(chosen))
    rank[length == 1] = -1
    split, reached = np.full((n, 2), -1), plain & (length == 1)
    if bpe:
        known = {p: i for i, p in enumerate(names) if plain[i]}
        for i in np.flatnonzero(merged):
            parts = list(names[i])
            while len(parts) > 2:
                options = [(rank[known[a + b]], k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in known]
                if not options:
                    break
                k = min(options)[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and parts[0] in known and parts[1] in known:
                split[i] = known[parts[0]], known[parts[1]]
                reached[i] = True
    else:
        reached = plain
    present = np.zeros(1 << 20, bool)
    present[keys >> np.uint64(44)] = True
    return Model(bpe, strings, keys[order], chosen[order], score, rank, raw, length, split, reached, byte, int(length[chosen].max()), present)


SPACE_TEXT = chr(SPACE)


def _decide(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each two pieces, side by side, are encoded as themselves."""
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(live):
        joined = m.find(_finish(m.raw[a] + m.raw[b] * _UP[m.length[a]], m.length[a] + m.length[b]))
        broken = (joined >= 0) & (m.rank[joined] < limit)
        out[live[broken]] = False
        # The piece merged last is undone; of two alike the right one.
        left = m.rank[a] > m.rank[b]
        over = np.where(left, m.rank[a], m.rank[b]) < 0
        keep = ~broken & ~over
        live, a, b, left = live[keep], a[keep], b[keep], left[keep]
        limit = np.where(left, m.rank[a], m.rank[b] + 1)
        a, b = np.where(left, m.split[a, 1], a), np.where(left, b, m.split[b, 0])
    return out


def fits(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_decide`` through a table of the pairs decided before."""
    pair = (a << 20) | b
    slot = (mix64(pair.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
    held = m.seen[slot]
    out = (held & 1).astype(bool)
    new = np.flatnonzero(held >> 1 != pair + 1)
    if len(new):
        fresh, back = np.unique(pair[new], return_inverse=True)
        valid = _decide(m, fresh >> 20, fresh & 0xFFFFF)
        out[new] = valid[back]
        m.seen[slot[new]] = ((pair[new] + 1) << 1) | out[new]
    return out


def viterbi(m: Model, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length, as rows of code points: (tokens, right-aligned;
    number of tokens).  A character without a piece is the token -1 - character."""
    n, size = letters.shape
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_POINT[letters] * _UP[:size], axis=1, out=sums[:, 1:])
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    last = np.full((n, size + 1), -1)
    step = np.zeros((n, size + 1), np.int64)
    for end in range(1, size + 1):
        for width in range(1, min(m.longest, end) + 1):
            at = end - width
            piece = m.find(_finish((sums[:, end] - sums[:, at]) * _DOWN[at], width))
            if width == 1:
                unknown = piece < 0
                piece = np.where(unknown, -1 - letters[:, at].astype(np.int64), piece)
            rows = np.flatnonzero((unknown | (piece >= 0)) if width == 1 else piece >= 0)
            rows = rows[np.isfinite(best[rows, at])]
            if not len(rows):
                continue
            p, before = piece[rows], last[rows, at]
            if m.bpe:
                ok = (p < 0) | m.reached[np.maximum(p, 0)]
                both = np.flatnonzero(ok & (p >= 0) & (before >= 0)) if at else np.zeros(0, int)
                if len(both):
                    ok[both] = fits(m, before[both], p[both])
                value = np.where(ok, 0.0, -np.inf)
            else:
                value = best[rows, at] + np.where(p < 0, m.score.min() - 10, m.score[np.maximum(p, 0)])
            better = value > best[rows, end]
            rows = rows[better]
            best[rows, end], last[rows, end], step[rows, end] = value[better], p[better], width
    out = np.zeros((n, size), np.int64)
    count = np.zeros(n, np.int64)
    end = np.full(n, size)
    live = np.arange(n)
    while len(live):
        count[live] += 1
        out[live, size - count[live]] = last[live, end[live]]
        end[live] -= step[live, end[live]]
        live = live[end[live] > 0]
    return out, count


def walk(m: Model, letters: np.ndarray) -> list[int]:
    """Tokens of one long word: the same search, with the probes and the pairs
    of neighbours vectorised along the word."""
    n, widths = len(letters), min(m.longest, len(letters))
    up, down = words._powers(max(n, words.PIECE_BYTES))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_POINT[letters] * up[:n], dtype=np.uint64)])
    piece = np.full((n, widths), -1)  # [start, width - 1]
    for w in range(1, widths + 1):
        piece[:n - w + 1, w - 1] = m.find(_finish((sums[w:] - sums[:n - w + 1]) * down[:n - w + 1], w))
    usable = (piece >= 0) & m.reached[np.maximum(piece, 0)]
    unknown = piece[:, 0] < 0
    piece[unknown, 0], usable[unknown, 0] = -1 - letters[unknown].astype(np.int64), True
    follows = np.zeros((n, widths), np.uint64)  # [start, width of the piece before - 1]: widths allowed here, as bits
    follows[0] = usable[0].astype(np.uint64) @ (np.uint64(1) << np.arange(widths, dtype=np.uint64))
    for a in range(1, widths + 1):
        for b in range(1, widths + 1):
            at = np.arange(a, n)
            at = at[usable[at - a, a - 1] & usable[at, b - 1]]
            left, right = piece[at - a, a - 1], piece[at, b - 1]
            ok = np.ones(len(at), bool)
            both = np.flatnonzero((left >= 0) & (right >= 0)) if m.bpe else np.zeros(0, int)
            ok[both] = fits(m, left[both], right[both])
            follows[at[ok], a - 1] |= np.uint64(1 << (b - 1))
    value = np.where(piece >= 0, 0.0 if m.bpe else m.score[np.maximum(piece, 0)], 0.0 if m.bpe else m.score.min() - 10).tolist()
    best, last = [-np.inf] * (n + 1), [1] * (n + 1)
    best[0] = 0.0
    rows = follows.tolist()
    for at in range(n):
        bits, b = rows[at][last[at] - 1] if best[at] > -np.inf else 0, 0
        while bits:
            if bits & 1 and best[at] + value[at][b] > best[at + b + 1]:
                best[at + b + 1], last[at + b + 1] = best[at] + value[at][b], b + 1
            bits, b = bits >> 1, b + 1
    out, at = [], n
    while at:
        out.append(int(piece[at - last[at], last[at] - 1]))
        at -= last[at]
    return out[::-1]


def _learn(m: Model, points: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> None:
    """Encodes words (ascending hashes) that are not remembered yet."""
    if len(m.words) + len(hashes) > REMEMBERED:
        m.words, m.place, m.pool = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, np.int32)
    tokens, place, total = [m.pool], np.zeros((2, len(start)), np.int64), len(m.pool)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        size = int(length[order[i]])
        if size > LONG:
            for row in order[i:j]:
                found = walk(m, points[start[row]:start[row] + size])
                tokens.append(np.array(found, np.int32))
                place[:, row] = total, len(found)
                total += len(found)
            continue
        most = max(1, (1 << 19) // size)  # bounds the cells of a batch
        for k in range(i, j, most):
            rows = order[k:min(j, k + most)]
            found, n = viterbi(m, points[start[rows][:, None] + np.arange(size)])
            tokens.append(found[np.arange(size) >= size - n[:, None]].astype(np.int32))
            place[:, rows] = total + np.cumsum(n) - n, n
            total += len(tokens[-1])
    at = np.searchsorted(m.words, hashes)
    m.words, m.place, m.pool = np.insert(m.words, at, hashes), np.insert(m.place, at, place, axis=1), np.concatenate(tokens)


def encode(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, first id of every text; one more entry
    closes the last)."""
    spaced = [SPACE_TEXT + t.replace(" ", SPACE_TEXT) if t else "" for t in texts]
    points = _points("".join(spaced))
    at = np.concatenate([[0], np.cumsum([len(t) for t in spaced])])
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = points == SPACE
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(points))
    hashes, sample, word = np.unique(words.span_hashes(points, start, end, _POINT), return_index=True, return_inverse=True)
    i = np.searchsorted(m.words, hashes)
    new = np.flatnonzero((i == len(m.words)) | (m.words[np.minimum(i, len(m.words) - 1)] != hashes) if len(m.words) else np.ones(len(hashes), bool))
    if len(new):
        if len(m.words) + len(new) > REMEMBERED:
            new = np.arange(len(hashes))
        _learn(m, points, start[sample[new]], (end - start)[sample[new]], hashes[new])
        i = np.searchsorted(m.words, hashes)
    offset, take = m.place[:, i[word]]
    run = np.cumsum(take)
    at_pool = np.repeat(offset - (run - take), take)
    at_pool += np.arange(run[-1])
    ids = m.pool[at_pool]
    del at_pool
    first = np.concatenate([[0], run])[np.searchsorted(start, at)]
    if (ids < 0).any():  # byte pieces
        point = np.where(ids < 0, -1 - ids.astype(np.int64), 0)
        wide = np.where(ids >= 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        spread = np.concatenate([[0], np.cumsum(wide)])
        which = np.repeat(np.arange(len(ids)), wide)
        raw = np.frombuffer("".join(map(chr, point[ids < 0])).encode("utf-8", "surrogatepass"), np.uint8)
        ids, low = ids[which], ids[which] < 0
        ids[low] = m.byte[raw]
        first = spread[first]
    return ids.astype(np.int32), first


def decode(m: Model, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """The text of each span of ids between two entries of ``first``."""
    size = np.array([len(s) for s in m.strings])
    blob = np.frombuffer(b"".join(m.strings), np.uint8)
    begin = np.cumsum(size) - size
    take = size[ids]
    run = np.concatenate([[0], np.cumsum(take)])
    at = np.repeat(begin[ids] - run[:-1], take)
    at += np.arange(run[-1])
    data = blob[at].tobytes()
    del at
    return [data[i:j].decode("utf-8", "replace")[1 if data[i:i + 1] == b" " else 0:] for i, j in zip(run[first[:-1]], run[first[1:]], strict=True)]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_documents(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_tokens, ids, round_trip) per row of ``docs``;
    round_trip: decoding the ids gives the text again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for batch in batches:
            for part in words.chunks(batch, "text"):
                texts = _texts(part["text"])
                ids, first = encode(m, texts)
                same = [a == b for a, b in zip(texts, decode(m, ids, first), strict=True)]
                null = part["text"].is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(np.diff(first), mask=null), lists, pa.array(same, mask=null)], ["id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id_col, text) per row of ``encoded``; null ids decode to null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = part["ids"]
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                texts = decode(m, ids, np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
