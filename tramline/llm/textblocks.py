"""Whole blocks of texts as numpy arrays: word boundaries and 64-bit word hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For comparing wording only: everything in ASCII but letters and digits separates words.
_LOOSE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240607))
#: A random odd value for each byte, and the base of the polynomial (5 modulo 8) with its inverse modulo 2^64.
_BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        row = np.full(size, base, U)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Position-independent hashes of the spans of a polynomial prefix sum."""
    inverse = pow(base, -1, 1 << 64)
    return (prefix[ends] - prefix[starts]) * powers(inverse, len(prefix))[starts]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


@dataclass
class Block:
    """Texts of a few rows. words[i] of row r are those from offsets[r] to offsets[r + 1]."""

    data: np.ndarray  # bytes
    rows: np.ndarray  # byte offsets of rows
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    offsets: np.ndarray  # word offsets of rows
    hashes: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.offsets))

    def hashes_of_rows(self) -> np.ndarray:
        """The word hash of rows that are one word or empty."""
        out = np.zeros(len(self.rows) - 1, U)
        out[np.diff(self.offsets) == 1] = self.hashes
        return out

    def text(self, row: int) -> bytes:
        return self.data[self.rows[row] : self.rows[row + 1]].tobytes()

    def windows(self, k: int, base: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words that lie in one row, and the word each starts at."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.arange(n - k + 1)
        row = self.row_of
        at = at[row[: n - k + 1] == row[k - 1 :]]
        return mix(span_hashes(prefix_sums(self.hashes, base), at, at + k, base) + U(k)), at


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the rows' offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def block(column: pa.Array, lower: bool = False, loose: bool = False) -> Block:
    """``lower`` folds A-Z; ``loose`` folds the case of all letters and lets ASCII punctuation separate words."""
    data, rows = bytes_of(pc.utf8_lower(column) if loose else column)
    if lower:
        data = _LOWER[data]
    space = (_LOOSE if loose else _SPACE)[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    prefix = prefix_sums(_BYTE[data], _BASE)
    hashes = mix(span_hashes(prefix, starts, ends, _BASE) + (ends - starts).astype(U))
    return Block(data, rows, starts, ends, np.searchsorted(starts, rows), hashes)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, rows = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
