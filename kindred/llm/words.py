"""Vectorised word hashing over Arrow string columns.

One pass of NumPy over the raw UTF-8 buffer finds every word
``[^\\x20\\x09-\\x0D]+`` of every row, lower-cases A-Z on the fly and gives each
word a 64-bit hash.  Nothing is decoded and no Python object is made per word,
so a row may be arbitrarily long; rows are taken in blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Rows are grouped into blocks of about so many text bytes (a longer row is a block of its own).
BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(1))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, _BASE_INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


class Words(NamedTuple):
    """Words of a block of rows: row ``r`` owns words ``first[r]:first[r + 1]``."""

    hashes: np.ndarray
    first: np.ndarray


def hash_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> Words:
    """Words of rows ``data[offsets[r]:offsets[r + 1]]`` (bytes of UTF-8); ``breaks`` tells the bytes between words."""
    offsets = offsets.astype(np.int64) - int(offsets[0])
    n = len(data)
    if n == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    solid = ~breaks[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    return Words(hashes, np.searchsorted(start, offsets))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of a string column, in bounded blocks; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    if rows == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(rows, max(row + 1, stop))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1]
        row = stop


_STEP = np.uint64(0xA24BAED4963EE407)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; none where fewer are left."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        out = mix(out ^ words[i : n + i]) + _STEP
    return out


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each row the hashes of its distinct ``size``-word shingles, ascending; fewer words make one shingle, none makes none."""
    whole, sets = windows(words.hashes, size), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            found = np.sort(whole[a : b - size + 1])
            fresh = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            sets.append(found[fresh])
        else:
            sets.append(windows(words.hashes[a:b], b - a) if b > a else words.hashes[:0])
    return sets
