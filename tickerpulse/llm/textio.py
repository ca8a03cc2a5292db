"""Whole Arrow columns of text as byte arrays: cutting into words and hashing them without a loop over words.

The functions take the bytes of many texts at once. ``blocks`` bounds how many: a block holds whole texts of
about ``block_bytes`` together, so memory depends on the block and on the longest single text only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U64)

# Words are runs of ASCII letters, digits, "_" and anything outside ASCII; the callers lower the case.
WORD_BYTES = np.zeros(256, bool)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD_BYTES[_c] = True
WORD_BYTES[128:] = True
WORD_PATTERN = r"[0-9A-Za-z_\u0080-\U0010ffff]+"


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other and where each begins (one entry more); NULL counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def blocks(starts: np.ndarray, block_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``block_bytes`` bytes each."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of True, cut where a text begins."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[starts] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    values = (values ^ (values >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> U64(32))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, the same wherever the span stands."""
    return sequence_hashes(_BYTE[data], begin, end)


def sequence_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values between each begin and end, in their order."""
    if not len(begin):
        return np.zeros(0, U64)
    powers = np.cumprod(np.full(len(values), _BASE, U64))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * powers)])
    backs = np.cumprod(np.full(len(values), _INVERSE, U64))
    return mix((sums[end] - sums[begin]) * backs[begin] + (end - begin).astype(U64))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of every word, and the number of each text's first word (one entry more)."""
    begin, end = runs(WORD_BYTES[data], starts[:-1])
    return begin, end, span_hashes(data, begin, end), np.searchsorted(begin, starts)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every ``size`` words in a row within a text, and the number of each text's first one.

    A text of fewer words, but at least one, has a single shingle of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(np.arange(len(counts)), n)
    at = first[:-1][rows] + np.arange(offsets[-1]) - offsets[:-1][rows]
    padded = np.concatenate([hashes, np.zeros(size, U64)])
    left = first[1:][rows] - at
    out = np.zeros(len(at), U64)
    for k in range(size):
        out = out * _BASE + np.where(k < left, padded[at + k], U64(0))
    return mix(out), offsets


def sets_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's values sorted and without repeats."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return np.compress(new, values), np.searchsorted(np.compress(new, rows), np.arange(len(offsets)))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values with offsets as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


class UnitCache:
    """Ids of repeated pieces of text. ``encode`` runs once for every distinct unit that the cache does not hold; all
    occurrences are then looked up together. ``most`` bounds the entries: a full cache starts afresh.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 3_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.length, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and the number of each unit's first id (one entry more)."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        distinct, one, back = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if not known.all():
            new = one[~known]
            raw = data.tobytes()
            found = self.encode([raw[b:e] for b, e in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])
            where = at[~known]
            self.keys = np.insert(self.keys, where, distinct[~known])
            self.start, self.length = np.insert(self.start, where, starts), np.insert(self.length, where, lengths)
            at = np.searchsorted(self.keys, distinct)
        start, length = self.start[at][back], self.length[at][back]
        offsets = np.concatenate([[0], np.cumsum(length)])
        return self.ids[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets
