"""Vectorised work on the words of whole Arrow batches of texts.

A batch's texts lie one after the other in one UTF-8 buffer. Words are maximal runs of bytes other
than ``[\\x20\\x09-\\x0D]``; no word or shingle crosses from one text to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [(1 << 64) - 1], np.uint64)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, with 8 zero bytes after them, and its n + 1 offsets.

    A null text has no bytes.
    """
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    out = np.zeros(size + 8, np.uint8)
    if size:
        own = np.frombuffer(data, np.uint8, size, int(offsets[0]))
        out[:size] = _LOWER[own] if lower else own
    return out, offsets - offsets[0]


#: Separators of words of letters and digits: every other ASCII character.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(x).isalnum() for x in range(128)]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and lengths of all words, and the number of words before each text (n + 1 long)."""
    size = int(offsets[-1])
    inside = ~separator[data[:size]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < size)]
    both = borders[inside[borders] & inside[borders - 1]]
    first[both] = True
    last[both - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, taken 8 bytes at a time over all words at once."""
    eights = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    out = lengths.astype(np.uint64) * _M1
    todo, k = np.arange(len(starts)), 0
    while len(todo):
        left = np.minimum(lengths[todo] - k, 8)
        part = eights[starts[todo] + k] & _MASKS[left]
        out[todo] = mixed((out[todo] ^ part) * _M1)
        k += 8
        todo = todo[lengths[todo] > k]
    return out


def rolled_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on, whatever text they are of (fewer at the end)."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        out[: len(hashes) - k] = mixed((out[: len(hashes) - k] ^ hashes[k:]) * _M1 + np.uint64(k + 1))
    return out


def shingle_hashes(hashes: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and the number of them before each text.

    A text of 1 to n - 1 words has one shingle, its whole sequence of words; one without words has none.
    """
    counts = np.diff(word_at)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    if not len(hashes):
        return np.zeros(0, np.uint64), at
    rolled = rolled_hashes(hashes, n)
    keep = np.zeros(len(hashes) + 1, np.int64)
    full = counts >= n
    np.add.at(keep, word_at[:-1][full], 1)
    np.add.at(keep, word_at[1:][full] - n + 1, -1)
    short = np.flatnonzero((counts > 0) & ~full)
    picked = np.cumsum(keep[:-1]) > 0
    for i in short:
        x = np.uint64(0)
        for k, h in enumerate(hashes[word_at[i] : word_at[i + 1]]):
            x = mixed(np.array([(int(x) ^ int(h)) * int(_M1) + k + 1 & (1 << 64) - 1], np.uint64))[0]
        rolled[word_at[i]] = mixed(np.array([int(x) ^ int(counts[i])], np.uint64))[0]
        picked[word_at[i]] = True
    return rolled[picked], at
