"""Words and hashes of whole Arrow batches, by NumPy over their UTF-8 bytes.

Both word classes of this package only name ASCII separators, so words can be cut
on bytes: every byte of a character beyond ASCII belongs to a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CODES = np.arange(256)

# [^\x20\x09-\x0D]+
BLANK_WORDS = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became lower case: digits, a-z and all beyond ASCII.
ALNUM_WORDS = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)

_TABLE = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finaliser)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BY_PLACE = randoms(_TABLE, 1 << 20)


@dataclass
class Texts:
    """The bytes of a batch of texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(LOWER[raw] if lower else raw, offsets - offsets[0])


def runs(texts: Texts, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the longest runs of ``member`` bytes within each text."""
    inside = member[texts.data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty, ascending) byte run: a multilinear sum by place, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    spread = place + np.repeat(starts - at, lengths)
    place -= np.repeat(at, lengths)
    if lengths.max() <= _TABLE:
        factor = _BY_PLACE[place]
    else:
        with np.errstate(over="ignore"):
            factor = mix((place.astype(np.uint64) + np.uint64((1 << 20) + 1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        factor = factor * (data[spread].astype(np.uint64) + np.uint64(1))
        return mix(np.add.reduceat(factor, at) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the text that holds each byte position."""
    return np.searchsorted(offsets, starts, "right") - 1


def windows(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hashes of all runs of ``k`` following words (one for each start that leaves room)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(randoms(k, seed)):
            total += words[j : j + n] * c
    return mix(total)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of ``batch`` with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
