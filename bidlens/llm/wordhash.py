"""Words and their 64-bit hashes for whole batches of texts, in numpy inside tasks.

A word is a run of characters other than space and U+0009 to U+000D. In UTF-8 these six characters are single bytes
that occur nowhere else, so the work is done on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18  # bytes hashed at once; longer documents are taken in pieces cut at spaces
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = np.atleast_1d(np.asarray(x, dtype=np.uint64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        down[0] = 1
        if n > 4 * CHUNK:  # one huge word: not worth keeping
            return np.cumprod(up), np.cumprod(down)
        _powers.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``value * BASE**position``; a difference times BASE**-start is the hash of a stretch."""
    up, _ = _power_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def unshift(starts: np.ndarray, n: int) -> np.ndarray:
    return _power_tables(n + 1)[1][starts]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offs


def chunks(offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together (or one longer row)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words do not cross rows."""
    solid = ~SPACE[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], end[last] = solid[first], solid[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def stretch_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each stretch, the same wherever it stands; stretches are sorted and disjoint."""
    table = BYTES[LOWER] if lower else BYTES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = rolling(table[buf[lo:hi]])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * unshift(starts[i:j] - lo, hi - lo)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def words(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end row, word boundaries of rows, word hashes, word lengths in bytes, bytes."""
    raw, offs = text_bytes(column)
    for i, j in chunks(offs):
        own = offs[i: j + 1] - offs[i]
        buf = raw[offs[i]: offs[j]]
        s, e = word_bounds(buf, own)
        cut = np.searchsorted(s, own)
        yield i, j, cut, stretch_hashes(buf, s, e, lower), s, e


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of one text; fewer words make one shingle of all."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        total = mix(total * _ODD + hashes[k: k + n])
    return np.unique(total)
