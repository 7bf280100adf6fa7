"""Words, shingles and their 64-bit hashes, computed for a whole slice of texts at a time.

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``. These bytes never occur inside a multi-byte
UTF-8 character, so everything here works on the UTF-8 bytes that Arrow hands to a task, without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes of text that are hashed at once; a longer text is a slice of its own
_SEED = np.random.RandomState(20260101)
_LETTER = _SEED.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _PLACE = np.uint64(0x9E3779B97F4A7C15), _SEED.randint(1, 1 << 62, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64, kept for the next slice unless it is very long."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SLICE + 1), base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if n <= 4 * SLICE:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Some consecutive rows: their bytes, and for each word its start, end and row."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray  # rows + 1
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    words: np.ndarray  # rows + 1: the words of row i are words[i]:words[i+1]

    def hashes(self, lower: bool = False, first: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first bytes; with lower, A-Z count as a-z."""
        n = len(self.data)
        letters = _LETTER[_LOWER] if lower else _LETTER
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(letters[self.data] * powers(_BASE, n), out=total[1:])
            end = self.end if first is None else np.minimum(self.end, self.start + first)
            return mix((total[end] - total[self.start]) * powers(_INVERSE, n + 1)[self.start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])  # all ASCII but letters and digits


def slices(column: pa.Array, limit: int = SLICE, between: np.ndarray = SPACE) -> Iterator[Slice]:
    """The rows of a string column in slices of about limit bytes; between marks the bytes that are in no word."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        part = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        inside = np.ones(len(part) + 2, bool)
        space = between[part]
        inside[0] = inside[-1] = False
        inside[1:-1] = ~space
        # a word also ends where its row does
        begins = inside[1:-1] & ~inside[:-2]
        begins[at[:-1][at[:-1] < len(part)]] |= inside[1:-1][at[:-1][at[:-1] < len(part)]]
        start = np.flatnonzero(begins)
        ends = inside[1:-1] & ~inside[2:]
        last = at[1:][at[1:] > 0] - 1
        ends[last] |= inside[1:-1][last]
        end = np.flatnonzero(ends) + 1
        words = np.searchsorted(start, at)
        yield Slice(i, j - i, part, at, start, end, np.repeat(np.arange(j - i), np.diff(words)), words)
        i = j


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the runs cross rows, so a caller keeps those that do not."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(m, np.uint64(n))
        for k in range(n):
            total += hashes[k : k + m] * _PLACE[k]
    return mix(total)


def shingle_sets(part: Slice, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct n-word shingles, ascending; with fewer words the whole text is one shingle."""
    of_n = grams(hashes, n)
    for i in range(part.rows):
        a, b = part.words[i], part.words[i + 1]
        if b - a >= n:
            x = np.sort(of_n[a : b - n + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            yield grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
