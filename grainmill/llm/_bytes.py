"""Vectorised word and shingle hashing over Arrow string buffers.

A text column arrives as one byte buffer with offsets. Word borders, word
hashes and shingle hashes come from a fixed number of numpy passes over that
buffer; no Python string is made for a word. Hashes are 64 bits wide: byte
values go through a table of odd random weights into a polynomial, and word
lengths and a final mixing step separate what the polynomial leaves close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once, so that the tables of powers stay in cache.
CHUNK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 & ~0x7 | 0x5  # 5 modulo 8
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mask(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Word bytes where words end at ASCII white space only.
SPACED = ~_mask([(0x09, 0x0D), (0x20, 0x20)])
#: Word bytes where words are letters and digits; every byte from 0x80 counts.
ALNUM = _mask([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look independent (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_EXACT = mix(np.arange(256, dtype=_U))
#: A-Z weigh as a-z do.
_FOLDED = _EXACT.copy()
_FOLDED[0x41:0x5B] = _EXACT[0x61:0x7B]

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


class Words:
    """Words of consecutive documents: hashes, byte spans and document borders.

    ``first[i]:first[i + 1]`` are the words of document ``i`` of the chunk, and
    ``edge[i]:edge[i + 1]`` its bytes.
    """

    __slots__ = ("docs", "edge", "first", "hash", "raw", "start", "stop")

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray, fold: bool = True) -> None:
        self.docs = len(at) - 1
        low, n = int(at[0]), int(at[-1] - at[0])
        self.raw, self.edge = raw[low : low + n], at - low
        edges = self.edge
        if not n:
            self.start = self.stop = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, _U), np.zeros(self.docs + 1, np.int64)
            return
        inside = np.zeros(n + 1, bool)
        inside[:n] = kind[self.raw]
        border = np.zeros(n + 1, bool)
        border[edges] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside[:-1]
        changes = inside != before
        cut = border & inside & before  # two documents touch inside what would be one word
        self.start = np.flatnonzero((changes | cut) & inside)
        self.stop = np.flatnonzero((changes | cut) & before)
        power, inverse = _tables(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum((_FOLDED if fold else _EXACT)[self.raw] * power[:n], out=sums[1:])
        size = (self.stop - self.start).astype(_U)
        self.hash = mix((sums[self.stop] - sums[self.start]) * inverse[self.start] + size * _U(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, edges)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def chunks(column: pa.Array | pa.ChunkedArray, kind: np.ndarray, fold: bool = True, size: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """Index of the first document, and the words, of runs of about ``size`` bytes; a document is never cut."""
    raw, at = buffers(column)
    low, docs = 0, len(at) - 1
    while low < docs:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, Words(raw, at[low : high + 1], kind, fold)
        low = high


_STEP = _U(0xC2B2AE3D27D4EB4F)


def sequence_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, without regard to document borders."""
    if len(words) < width:
        return np.zeros(0, _U)
    n = len(words) - width + 1
    out = np.full(n, width, _U)
    for i in range(width):
        out = (out ^ words[i : i + n]) * _STEP
        out ^= out >> _U(29)
    return mix(out)


def shingle_sets(words: Words, width: int = 5) -> Iterator[np.ndarray]:
    """For each document its distinct shingles, ascending; fewer words than ``width`` make one shingle, none make none."""
    every = sequence_hash(words.hash, width)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = high - low
        if n >= width:
            run = np.sort(every[low : high - width + 1])
            keep = np.empty(len(run), bool)
            keep[0] = True
            np.not_equal(run[1:], run[:-1], out=keep[1:])
            yield run[keep]
        else:
            yield sequence_hash(words.hash[low:high], n) if n else np.zeros(0, _U)


class Lookup:
    """Which of many hashes are in a sorted table: a bitmap first, then a search."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.bits = max(16, min(24, (16 * max(len(table), 1)).bit_length()))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(table >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` that are in the table, and where they are in it."""
        maybe = np.flatnonzero(self.map[values >> np.uint64(64 - self.bits)])
        at = np.searchsorted(self.table, values[maybe])
        at[at == len(self.table)] = 0
        hit = self.table[at] == values[maybe]
        return maybe[hit], at[hit]
