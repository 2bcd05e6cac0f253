"""Vectorised word arithmetic over Arrow string batches.

Every function works on the raw UTF-8 bytes of one batch: words are runs of
bytes other than space and ``\\t..\\r`` (so the pattern ``[^\\x20\\x09-\\x0D]+``),
and each word is identified by a 64-bit hash of its bytes.  Two different
words share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE_BYTES), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _STEP[0]
    x ^= x >> np.uint64(27)
    x *= _STEP[1]
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each of about SLICE_BYTES."""
    offsets = byte_offsets(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def byte_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty text."""
    column = column.fill_null("") if column.null_count else column
    offsets = byte_offsets(column)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("") if column.null_count else column


class RangeHash:
    """Hashes of any ranges of one array of small numbers."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _STEP[2])


class Words:
    """The words of some texts: byte ranges, hashes, and the words' range of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        n = len(data)
        data = LOWER[data] if lower else data
        inside = np.zeros(n + 2, bool)
        np.logical_not(SPACE[data], out=inside[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data, self.range_hash = data, RangeHash(data)
        self.hashes = self.range_hash(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within a text, and the run's first word."""
        owner, n = self.owner(), len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return sequence_hash([self.hashes[at + j] for j in range(k)]), at


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full_like(parts[0], len(parts))
    for j, h in enumerate(parts):
        total = mix(total * _STEP[3 - j % 2] + h * _STEP[j % 5] + np.uint64(j))
    return total
