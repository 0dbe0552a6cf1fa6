"""Vectorised word scanning over the UTF-8 bytes of Arrow string columns.

A chunk is a run of whole texts.  Words are found with byte masks, and a word, a
line or a window of words is hashed with one prefix sum modulo 2**64 per chunk,
so the cost is a few numpy passes per byte and nothing is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes that are no part of a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case: all but a-z, 0-9 and non-ASCII.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(U64) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_R, _R_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; see ``between``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _pow(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that does not depend on the place."""
    inverse = _pow(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


class Chunk:
    """Whole texts ``first .. first + n`` of a batch; ``off`` are their bytes in ``raw``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, first: int):
        self.raw, self.off, self.first, self.n = raw, off, first, len(off) - 1

    def words(self, separators: np.ndarray) -> Words:
        return Words(self, separators)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole texts of about ``limit`` bytes; a longer text is a chunk of its own.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Chunk(data[off[lo]:off[hi]], (off[lo:hi + 1] - off[lo]), lo)
        lo = hi


class Words:
    """The words of a chunk with A-Z in lower case: byte spans, text number and hash.

    ``lo``/``hi`` give, for each text, its first word and the word after its last.
    """

    def __init__(self, chunk: Chunk, separators: np.ndarray):
        self.chunk = chunk
        self.low = LOWER[chunk.raw]
        n = len(self.low)
        inside = ~separators[self.low]
        first = np.zeros(n + 1, bool)  # a text begins here
        first[chunk.off] = True
        starts, ends = inside.copy(), inside.copy()
        if n:
            starts[1:] &= ~inside[:-1] | first[1:n]
            ends[:-1] &= ~inside[1:] | first[1:n]
        self.inside = inside
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.lo = np.searchsorted(self.start, chunk.off[:-1])
        self.hi = np.searchsorted(self.start, chunk.off[1:])
        self.count = self.hi - self.lo
        self.doc = np.repeat(np.arange(chunk.n), self.count)
        self.hash = between(prefix(_BYTE[self.low]), self.start, self.end)
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix(self.hash)
        return self._sums

    def windows(self, n: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``n`` words inside one text;
        ``sums``: prefix sums over other hashes of the words."""
        at = np.arange(max(0, len(self.start) - n + 1))
        if n > 1:
            at = at[self.doc[at] == self.doc[at + n - 1]]
        return at, between(self.sums if sums is None else sums, at, at + n)

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` - 1, separated by one space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def raw_prefix(chunk: Chunk) -> np.ndarray:
    """Prefix sums over the bytes as they are, for ``between``."""
    return prefix(_BYTE[chunk.raw])


def per_doc(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi] for each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[hi] - total[lo]


def covered(first: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in some [first, first + length)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    return np.cumsum(change[:-1]) > 0
