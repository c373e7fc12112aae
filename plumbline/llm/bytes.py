"""Array helpers for whole texts as UTF-8 bytes: buffers of an Arrow column, words, and rolling hashes.

Texts are handled in slabs of about a megabyte (at least one document), so memory follows the slab and the longest
text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 20
_MULTIPLIER = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
U64 = np.uint64

#: Byte tables. Blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def spread(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a new array."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(29)
    return x


_TABLES = [spread(np.arange(1, 257, dtype=U64) * U64(_MULTIPLIER[k]) + U64(k)) for k in range(2)]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = pc.fill_null(wide, b"")
    n = len(wide)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges with at most `limit` bytes each, but at least one row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and row offsets into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = max(n, SLAB + 1)
        base = _MULTIPLIER[k]
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _POWERS[k] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return have[0][:n], have[1][:n]


def _prefix(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(values) + 1, k)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], dtype=U64, out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the bytes stand."""
    sums, down = _prefix(_TABLES[k][data], k)
    return spread((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(values: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive 64-bit values."""
    if len(values) < width:
        return np.zeros(0, U64)
    out = values[:len(values) - width + 1].copy()
    factor = 1
    for i in range(1, width):
        factor = factor * _MULTIPLIER[k] % (1 << 64)
        out += values[i:len(values) - width + 1 + i] * U64(factor)
    return spread(out)


def rolling_hashes(data: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive bytes."""
    if len(data) < width:
        return np.zeros(0, U64)
    sums, down = _prefix(_TABLES[k][data], k)
    return spread((sums[width:] - sums[:-width]) * down[:len(data) - width + 1])


def within_rows(offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of `width` items that begins at each position ends inside its row."""
    n = int(offsets[-1])
    if n < width:
        return np.zeros(0, bool)
    room = np.repeat(offsets[1:], np.diff(offsets))[:n - width + 1]
    return np.arange(n - width + 1) + width <= room


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of `n` positions lie under a window of `width` that begins at one of `starts`."""
    step = np.zeros(n + width + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0
