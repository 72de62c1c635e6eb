"""Vectorised word and window hashing over Arrow string columns.

A word is a maximal run of bytes that are not ASCII white space. All hashes are 64-bit polynomial
prefix sums over bytes (then over words) with an avalanche step, so every word and every window of
words costs a handful of numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20_240_101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Texts are worked on in slices of about this many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(2 * n, 1 << 20) + 1
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose text adds up to about ``limit`` bytes each, of ``rows`` rows at most."""
    k = batch.schema.get_field_index(column)
    raw, off = text_bytes(batch.column(k))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hashes of byte ranges."""
    up, down = _pow(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


class Words:
    """Words of a column: ``start``/``end`` are byte places in ``raw``, ``hash`` 64-bit values,
    ``first[d]:first[d + 1]`` the words of row d, ``doc`` the row of each word."""

    def __init__(self, column: pa.Array):
        self.raw, self.off = text_bytes(column)
        raw, off = self.raw, self.off
        n = len(raw)
        solid = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.hash = span_hashes(raw, self.start, self.end)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.place = np.arange(len(self.start)) - self.first[self.doc]
        self.left = self.first[self.doc + 1] - np.arange(len(self.start))  # words from here to the end of the row
        self._sums: np.ndarray | None = None

    def windows(self, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``width`` words that start at the words ``at`` (which must fit)."""
        up, down = _pow(len(self.hash) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * up[: len(self.hash)], out=self._sums[1:])
        return mix((self._sums[at + width] - self._sums[at]) * down[at])
