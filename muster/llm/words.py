"""Words of whole Arrow text columns, found with numpy on the UTF-8 bytes.

Shared by the operators that run inside ``mapInArrow``.  A column is handled in
blocks of whole rows, so memory follows the block and not the partition; one
row longer than a block is a block of its own.  Null counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
ODD = U64(0x9E3779B97F4A7C15)
#: What is left of 8 bytes, read as one number, if only the first 0 to 8 count.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Every byte but the line feed.
NOT_LF = np.ones(256, bool)
NOT_LF[0x0A] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _summed(values: np.ndarray, nth: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One hash per run of ``counts`` values, each mixed with its place ``nth`` in the run."""
    keys = mix((np.arange(int(counts.max(initial=0))).astype(U64) + U64(1)) * ODD)
    sums = np.append(U64(0), np.cumsum(mix(values + keys[nth]), dtype=U64))
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + lengths.astype(U64) * ODD)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span; equal spans hash alike wherever they stand.

    Each value is mixed with its place before they are added, so no pattern of
    values cancels out as it can in a polynomial modulo 2^64.  The work is the
    length of all spans: for overlapping ones see ``window_hashes``.
    """
    counts = ends - starts
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return _summed(values[np.repeat(starts, counts) + nth], nth, counts, counts)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for spans of bytes, eight bytes at a time."""
    lengths = ends - starts
    counts = (lengths + 7) >> 3
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts, counts) + 8 * nth
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    return _summed(eights[at] & _FIRST_BYTES[np.minimum(np.repeat(ends, counts) - at, 8)], nth, counts, lengths)


def window_hashes(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``values[i:i + size]`` for every ``i`` in ``at``, out of hashes of 1, 2, 4 ... neighbours."""
    out, level, width, done = None, values, 1, 0
    while True:
        if size & width:
            here = level[at + done]
            out = here if out is None else mix(out * ODD + here)
            done += width
        if done == size:
            return out
        level = mix(level[:-width] * ODD + level[width:])
        width *= 2


@dataclass
class Spans:
    """Words (or lines) of a block: byte positions, row in the block, hash."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


@dataclass
class Block:
    """Rows ``first`` to ``first + n`` of a batch as bytes with row offsets."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray

    def spans(self, inside: np.ndarray, lower: bool = False, hashes: bool = True) -> Spans:
        """Maximal runs of the bytes marked in ``inside``; none crosses a row."""
        data = LOWER[self.data] if lower else self.data
        mark = inside[data]
        begin, end = mark.copy(), mark.copy()
        begin[1:] &= ~mark[:-1]
        end[:-1] &= ~mark[1:]
        lo, hi = self.offsets[:-1], self.offsets[1:]
        full = hi > lo
        begin[lo[full]] = mark[lo[full]]
        end[hi[full] - 1] = mark[hi[full] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        row = np.searchsorted(self.offsets, starts, "right") - 1
        return Spans(starts, ends, row, byte_hashes(data, starts, ends) if hashes else np.zeros(0, U64))

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A text column in blocks of whole rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Block(at, to - at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of integer weights, by row."""
    return np.bincount(row, weights, n).astype(np.int64)


def windows(words: Spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the windows of ``size`` words that stay in one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(words.row[:n] == words.row[size - 1:])
    return at, window_hashes(words.hash, at, size)


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words starting at ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))
