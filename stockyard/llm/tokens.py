"""Words, word hashes and shingle hashes of Arrow text columns, vectorised over many documents.

A batch is cut into pieces of 256 KB so that temporaries, some 100 bytes a byte of text, stay small; a document
is never cut.
Null text has no words. Offsets are in bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates, and of words of digits, a-z and anything beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 20:
            _POWERS[base] = have
    return have[:n]


def pieces(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield at, stop, raw[offs[at] : offs[stop]], offs[at : stop + 1] - offs[at]
        at = stop


class Words:
    """Words of one piece: start and end in bytes, the row of each, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        n, self.rows = len(data), len(offs) - 1
        w = is_word[data]
        inner = offs[1:-1]
        before = np.zeros(n, dtype=bool)
        before[1:] = w[:-1]
        before[inner[inner < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = w[1:]
        after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.row = np.searchsorted(offs, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.data)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * _powers(_STEP, n), out=sums[1:])
            self._hash = mix((sums[self.end] - sums[self.start]) * _powers(pow(_STEP, -1, 1 << 64), n)[self.start]) if n else sums[:0]
        return self._hash

    def bytes_of(self, i: int, k: int = 1) -> bytes:
        """Words i to i+k-1 joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + k], self.end[i : i + k]))

    def shingles(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which k words of one row begin, and the hash of those k words."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = rolled(self.hash, k, salt)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, h[at]

    def whole_hash(self, r: int) -> int:
        """Hash of all words of row r."""
        a, b = self.first[r], self.first[r + 1]
        return int(rolled(self.hash[a:b], int(b - a), 0)[0])


def rolled(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    n = len(h) - k + 1
    step = U((0xD1342543DE82EF95 + 2 * salt * 0x2545F4914F6CDD1D) & (2**64 - 1) | 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= step
        out += h[j : j + n]
    return mix(out + U(k + 977 * salt))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
