"""Vectorised byte-level text work on Arrow string columns.

All functions work on the UTF-8 bytes of a whole Arrow batch, in slices that end at document
boundaries, so memory is bounded by ``SLICE_BYTES`` or by the longest single document.
Word separators are ASCII bytes, so cutting UTF-8 at them is safe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True where a byte separates words: the space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: True where a byte is no ASCII letter or digit and below 0x80 (after lower-casing).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the base and its inverse; those for usual slices are kept, longer ones are not."""
    if not _POWERS:
        _POWERS.extend((_powers(_BASE, SLICE_BYTES + 1), _powers(_BASE_INV, SLICE_BYTES + 1)))
    if n <= len(_POWERS[0]):
        return _POWERS[0][:n], _POWERS[1][:n]
    return _powers(_BASE, n), _powers(_BASE_INV, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Rows ``first`` .. ``first + len(offsets) - 1`` of a batch: bytes and row offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut an Arrow string column into slices of about ``limit`` bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        part = data[offsets[i] : offsets[j]]
        yield Slice(i, LOWER[part] if lower else part, (offsets[i : j + 1] - offsets[i]).astype(np.int64))
        i = j


@dataclass
class Words:
    """Word starts and ends (byte positions) of a slice, and the first word of each row."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # rows + 1 entries: row r has words first[r] .. first[r + 1] - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(s: Slice, separators: np.ndarray = SPACE) -> Words:
    word = ~separators[s.data]
    n = len(word)
    if n == 0:
        zero = np.zeros(0, dtype=np.int64)
        return Words(zero, zero, np.zeros(len(s.offsets), dtype=np.int64))
    begin = np.zeros(n + 1, dtype=bool)
    begin[s.offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | begin[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | begin[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, s.offsets))


def word_hashes(s: Slice, w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over the words' bytes from one running sum."""
    n = len(s.data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[s.data] * power[:n], out=total[1:])
    return mix64((total[w.ends] - total[w.starts]) * inverse[w.starts] + (w.ends - w.starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and the row of each.

    A row with at least one and fewer than ``k`` words has its whole sequence as one shingle; a row
    without words has none.
    """
    counts = np.diff(first)
    rows = len(counts)
    out, row_of = [], []
    n = len(hashes)
    if n >= k:
        row = np.repeat(np.arange(rows), counts)
        value = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - k + 1 + i]
        inside = row[: n - k + 1] == row[k - 1 :]
        out.append(mix64(value[inside] + np.uint64(k)))
        row_of.append(row[: n - k + 1][inside])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        value = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            at = np.minimum(first[short] + i, max(n - 1, 0))
            value = np.where(has, value * np.uint64(0xD6E8FEB86659FD93) + hashes[at], value)
        out.append(mix64(value + counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        row_of.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(row_of).astype(np.int64)


def distinct_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value, and the rows' offsets into them."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    v, r = values[order], rows[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(n_rows + 1))


class Lookup:
    """A read-only map from 64-bit keys to numbers: a direct table in front of a sorted array.

    The direct table's slot holds the heaviest key that hashes to it, so that most look-ups take one
    probe; the others search the sorted array.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 1)
        self.shift = np.uint64(64 - bits)
        heavy_last = np.argsort(weight[order], kind="stable").astype(np.int32)
        self.front = np.zeros(1 << bits, dtype=np.int32)
        self.front[self._slot(self.keys[heavy_last])] = heavy_last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions in ``self.values``, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self.front[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            k = keys[miss]
            i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            at[miss] = np.where(self.keys[i] == k, i, -1)
        return at
