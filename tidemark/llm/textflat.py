"""Flat-array text primitives shared by the corpus operators.

A batch of texts is held as one UTF-8 byte array with row offsets, exactly as Arrow
stores it.  Words, their 64-bit hashes and their owners are computed for the whole
batch by numpy passes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of one flat chunk.  A single longer text is its own chunk.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_TABLE = splitmix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_POW = np.ones(1, dtype=_U)
_INV = np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_POW", _BASE), ("_INV", inverse)):
            steps = np.full(size, base & (2**64 - 1), dtype=_U)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _POW, _INV


def _byte_set(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: Separators of `[^\x20\x09-\x0D]+`.
BLANKS = _byte_set([(0x20, 0x20), (0x09, 0x0D)])
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
NON_WORD = _byte_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
#: bytes.translate table: A-Z to a-z and each separator of NON_WORD to a space.
WORD_BYTES = np.where(NON_WORD[LOWER], 32, LOWER).astype(np.uint8).tobytes()


@dataclass
class Words:
    """Words of a chunk, in order: byte spans in `data`, and how many each row has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word, and one past the last."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes."""
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=_U)
        np.cumsum(_TABLE[self.data] * power[: len(self.data)], out=total[1:])
        got = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return splitmix(got + _U(1) + (self.ends - self.starts).astype(_U))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `size` bytes.

    Null texts are empty.  `offsets` has one entry more than there are rows.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, lower: bool = True) -> Words:
    """Maximal runs of bytes that are not separators, within each row."""
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(offsets) - 1, dtype=np.int64))
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return Words(data, starts, ends, np.diff(np.searchsorted(starts, offsets)))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their rows.

    A row with words, but fewer than n, has its whole sequence as one shingle; a row
    without words has none.
    """
    first = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(counts)), counts)
    total = len(hashes)
    if not total:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    place = np.arange(total) - first[row]
    left = counts[row] - place
    whole = (left >= n) | ((counts[row] < n) & (place == 0))
    at = np.flatnonzero(whole)
    size = np.minimum(n, left[at])
    out = size.astype(_U)
    for k in range(n):
        inside = size > k
        word = hashes[np.minimum(at + k, total - 1)]
        out = np.where(inside, splitmix(out * _U(0x100000001B3) + word), out)
    return out, row[at]
