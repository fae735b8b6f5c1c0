"""Vectorised tokenising and hashing of whole Arrow text columns.

A text column is handled as one byte buffer: word borders come from a byte class, word hashes
from one prefix sum of a polynomial over the bytes, and hashes of word runs from one prefix sum
over the words.  No loop runs over rows or words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93  # odd, so they have inverses modulo 2**64
CHUNK = 1 << 18  # bytes of text at once: some thirty times as many are held in arrays

# Byte classes: True where a byte separates words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse, made longer on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK + 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(self.n - 1, b, U)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_bytes, _words = _Powers(_BASE), _Powers(_WORD)


@dataclass
class Words:
    """Words of some rows of a column: byte borders within `data`, row, hash, and each row's first word."""

    data: np.ndarray
    offsets: np.ndarray  # of the rows in data
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def stop(self) -> np.ndarray:
        """Of each word, the index after the last word of its row."""
        return np.repeat(self.first[1:], self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words that begin at each word, and whether they all lie in its row."""
        n = len(self.hash)
        up, down = _words.get(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        at = np.arange(n)
        till = np.minimum(at + k, n)
        return mix((total[till] - total[:n]) * down[:n]), at + k <= self.stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    raw = column.buffers()
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]


def slices(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def segment(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each byte range [begins, ends)."""
    n = len(data)
    up, down = _bytes.get(n + 1)
    total = np.zeros(n + 1, U)
    value = (_LOWER[data] if lower else data).astype(U)
    value += U(1)
    value *= up[:n]
    np.cumsum(value, out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins])


def words(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False, most: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) of ranges of rows."""
    everything, offsets = buffers(column)
    for a, b in slices(offsets, most):
        data, off = everything[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        use = separators[(_LOWER[data] if lower else data)]
        start, end = runs(~use, off)
        first = np.searchsorted(start, off).astype(np.int64)
        yield a, b, Words(data, off, start, end, np.repeat(np.arange(b - a), np.diff(first)), segment(data, off, start, end, lower), first)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the runs of True that do not cross a row's border."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = off[(off > 0) & (off < n)]
    before[cut], after[cut - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def occurrences(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each value has come before in its row."""
    if not len(value):
        return np.zeros(0, np.int64)
    key = mix(value + mix(row.astype(U)))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    at = np.arange(len(value))
    out = np.empty(len(value), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i (shorter at the end), by doubling."""
    out, have, w = x.copy(), 1, min(w, len(x))
    while have < w:
        step = min(have, w - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(value: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Positions holding the least of `value` in a window of w positions; whole: the window that begins there lies in one row."""
    if not len(value):
        return np.zeros(0, np.int64)
    least = np.where(whole, sliding_min(value, w), U(0))
    back = ~sliding_min(~least[::-1], w)[::-1]  # the largest of the minima of the windows that hold a position
    return np.flatnonzero((back == value) & (back != 0))


def keys(column: pa.Array) -> pa.Array:
    """128-bit digest of each text; null is empty."""
    return pa.array([hashlib.blake2b(b"" if x is None else x.as_buffer(), digest_size=16).digest() for x in _scalars(column)], pa.binary())


def _scalars(column: pa.Array) -> Iterator[pa.Scalar | None]:
    for x in column:
        yield x if x.is_valid else None


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
