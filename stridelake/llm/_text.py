"""Vectorised word scanning and hashing over Arrow string buffers.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``.  All functions work on
slices of bounded size and go through whole texts, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (int(n) - 1).bit_length())
            self.up, self.down = _powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(_BASE)
_LANES = [_Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _piece_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _BYTES.get(len(b) + 1)
    prefix = np.empty(len(b) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Return (start, end, 64-bit hash) of every word, and each row's first word number (one more entry than rows)."""
    hashes, n = [], len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_WS[raw]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[cuts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    if lower:
        raw = _LOWER[raw]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        a, z = starts[lo], ends[hi - 1]
        hashes.append(_piece_hashes(raw[a:z], starts[lo:hi] - a, ends[lo:hi] - a))
        lo = hi
    return starts, ends, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(starts, offsets, "left")


def windows(hashes: np.ndarray, first: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one row: (row, word number within the row, hash)."""
    n = len(hashes)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n < k:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    at = np.flatnonzero(np.arange(n) + k <= first[rows + 1])
    out = np.empty(len(at), np.uint64)
    powers, lo = _LANES[lane], 0
    while lo < len(at):  # pieces, so that the tables of powers stay small
        hi = min(len(at), lo + PIECE)
        a, z = at[lo], at[hi - 1] + k
        hi = int(np.searchsorted(at, a + 2 * PIECE, "right")) if z - a > 2 * PIECE else hi
        z = at[hi - 1] + k
        up, down = powers.get(z - a + 1)
        prefix = np.empty(z - a + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(hashes[a:z] * up[:-1], out=prefix[1:])
        here = at[lo:hi] - a
        out[lo:hi] = mix((prefix[here + k] - prefix[here]) * down[here])
        lo = hi
    return rows[at], at - first[rows[at]], out
