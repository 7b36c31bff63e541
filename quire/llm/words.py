"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes of a class; A-Z fold to a-z.  Both rules used
here are byte rules on UTF-8, so no text is decoded and no word becomes a
Python object.  A word's hash is a polynomial over random 64-bit byte codes
(mod 2^64, odd base), taken from one running sum: the sum at the word's end
less the sum at its start, divided by the base's power at the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at once inside a task; temporaries are a few dozen times this.
CHUNK_BYTES = 1 << 21
PIECE_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_code = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_code[65:91] = _code[97:123]  # A-Z as a-z

#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after folding: digits, letters, every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_lo:_hi] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have ``limit`` bytes at most, or one row."""
    _, at = text_bytes(batch[column])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()  # buffers of earlier batches go back to the system


def word_spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word crosses a text's end."""
    inside = kind[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = _code) -> np.ndarray:
    """64-bit hash of every span (ascending, not overlapping), piece by piece.
    ``code`` gives the value of each byte or code point."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _powers(max(PIECE_BYTES, hi - lo))
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[data[lo:hi]] * up[: hi - lo], out=run[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix64((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of every text; one more entry
    closes the last)."""
    data, at = text_bytes(column)
    start, end = word_spans(data, at, kind)
    return span_hashes(data, start, end), np.searchsorted(start, at)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text of each; a text with
    fewer words, but not none, gives its whole sequence as one."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    left = first[1:][text] - np.arange(len(h))  # words from here to the text's end
    whole = (left == n[text]) & (left < size)
    keep = np.flatnonzero((left >= size) | whole)
    out = np.zeros(len(keep), np.uint64)
    short = whole[keep]
    for k in range(size):
        step = h[np.minimum(keep + k, len(h) - 1)] * np.uint64(2 * (k + 1) * 0x2545F4914F6CDD1D % 2**64 | 1)
        out = np.where(short & (k >= left[keep]), out, mix64(out + step))
    out[short] = mix64(out[short] ^ n[text[keep[short]]].astype(np.uint64))
    return out, text[keep]
