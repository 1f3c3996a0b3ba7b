"""Words, lines and their hashes for whole Arrow slices at once, in numpy.

Word patterns over code points are read off UTF-8 bytes: both patterns in use put all
bytes from 0x80 in one class, so byte runs and code point runs are the same.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import offsets

_BYTE = np.arange(256)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A))
#: [^\x20\x09-\x0D]+
GRAPH = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
NOT_NEWLINE = _BYTE != 0x0A
#: A-Z to a-z, other bytes as they are.
FOLD = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
SAME = _BYTE.astype(np.uint8)

_ODD = 0x9E3779B97F4A7C1B  # 3 modulo 8: powers differ in few low bits
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column without nulls."""
    at = offsets(column)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Runs(NamedTuple):
    """Runs of one byte class: where they start and end, and the row each is in."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Runs:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    is_in = inside[data]
    first, last = is_in.copy(), is_in.copy()
    first[1:] &= ~is_in[:-1]
    last[:-1] &= ~is_in[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] |= is_in[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] |= is_in[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Runs(start, end, np.searchsorted(offsets, start, side="right") - 1)


class Hasher:
    """64-bit hashes of any byte ranges of data in constant time each."""

    def __init__(self, data: np.ndarray, fold: np.ndarray = SAME):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = _RANDOM[fold][data]
        terms *= _power(_ODD, len(data))
        np.cumsum(terms, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _power(_ODD_INVERSE, len(self.sums))[start]
        return mix(h + (end - start).astype(np.uint64))


def grams(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one row, and the index of the first word of each."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h *= np.uint64(_ODD)
        h += words[j : j + n]
    return mix(h[at]), at


def long_grams(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As grams(), in a time that doesn't grow with k: from running sums. The hashes are other ones."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_ODD, len(words)), out=sums[1:])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix((sums[at + k] - sums[at]) * _power(_ODD_INVERSE, len(sums))[at] + np.uint64(k)), at


def _sliding(values: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """best of every window consecutive values, in a time that grows with the logarithm of window."""
    size = 1
    while 2 * size <= window:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (window - size)], values[window - size :]) if size < window else values


def winnow(hashes: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Indices of the minima of every window of consecutive hashes of a row, all of them on a tie. A row
    with fewer hashes than a window has one window, all of them."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[begins, n])
    keep = np.zeros(n, bool)
    if n >= window:
        # The largest of the minima of the windows that hold a place is its own hash if it is the least of one.
        least = _sliding(hashes, window, np.minimum)
        least[row[: n - window + 1] != row[window - 1 :]] = 0
        edge = np.zeros(window - 1, np.uint64)
        keep = _sliding(np.concatenate([edge, least, edge]), window, np.maximum) == hashes
    for b, size in zip(begins[sizes < window].tolist(), sizes[sizes < window].tolist(), strict=True):
        keep[b : b + size] = hashes[b : b + size] == hashes[b : b + size].min()
    return np.flatnonzero(keep)


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums by row, as integers."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)
