"""Hashes of words and word windows, computed over Arrow buffers without making a string per word.

A word's hash is a polynomial over its bytes, a window's one over its words' hashes, both modulo 2**64 and
mixed afterwards. Windows cost the same at every length, because prefix sums are kept. Where equality of
words decides a result, windows are compared by two independent hashes (128 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a single longer text is taken whole.
SLICE = 2 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values after which every bit depends on every other."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_set(*bounds: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in bounds:
        out[a : b + 1] = True
    return out


#: Bytes of words: all but white space; or letters, digits and all of non-ASCII text.
NOT_SPACE = ~_byte_set((9, 13), (32, 32))
ALNUM = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTER = _byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.where(_byte_set((0x41, 0x5A)), SAME + 32, SAME).astype(np.uint8)
_TABLE = mix(np.arange(256, dtype=np.uint64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for b in (self.base, self.inverse):
                a = np.full(max(n, 1024), b, np.uint64)
                a[0] = 1
                made.append(np.cumprod(a, dtype=np.uint64))
            if n > 8 * SLICE:  # a giant text: not kept
                return made[0], made[1]
            self.up, self.down = made
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _hasher(values: np.ndarray, powers: _Powers) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function of bounds that gives the polynomial hash of values[start:end] for each pair."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return lambda start, end: (sums[end] - sums[start]) * down[start]


def byte_window_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same for stretches of bytes; not mixed yet."""
    return _hasher(_TABLE[data], _BYTES)


def byte_windows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return byte_window_hasher(data)(start, end)


@dataclass
class Words:
    """The words of some texts: bounds in ``data``, the first word of each text, and their hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def window_starts(self, k: int) -> np.ndarray:
        """First words of all windows of k words that lie in one text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(len(self.hash)) + k <= last)

    def window_hashes(self, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        values = mix(self.hash ^ _M2) if second else self.hash
        return mix(_hasher(values, _WORDS)(start, end) ^ (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME) -> Words:
    """Words are maximal runs of ``inside`` bytes within a text; ``fold`` maps bytes before hashing (LOWER: A-Z)."""
    n = len(data)
    mask, cuts = inside[data], offsets[(offsets > 0) & (offsets < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[cuts], after[cuts - 1] = False, False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    hashes = mix(byte_windows(fold[data], start, end) ^ (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE) -> Iterator[tuple]:
    """(rows, bytes, offsets) of consecutive rows that hold about ``limit`` bytes of text. Null texts are empty."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        text = part.column(column).cast(pa.large_string()).fill_null("")
        if not len(text):
            continue
        _, bounds, data = text.buffers()
        offsets = np.frombuffer(bounds, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield part.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
