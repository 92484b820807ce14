"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its id is a
64-bit polynomial hash of its bytes, mixed; ids of different words differ but
for chance (2^-64 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 2 << 20  # bytes of text looked at together; a longer text is a segment of its own
_U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M = 0x9E3779B97F4A7C15 | 1
_MI = pow(_M, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        made = []
        for base in (_M, _MI):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * SEGMENT:
            return made  # of one very long text; not kept
        _powers[:] = made
    return _powers


@dataclass
class Words:
    """Words of consecutive rows ``first .. first + rows``; ``data`` holds their bytes, ``offsets`` the rows' bounds."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    row: np.ndarray
    bounds: np.ndarray  # words bounds[i]:bounds[i + 1] belong to row i


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the rows' bounds; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool, first: int = 0, separator: np.ndarray = SEPARATOR) -> Words:
    """Words of the rows whose bytes are ``data``; ``separator`` tells the bytes between words."""
    n = len(data)
    solid = ~separator[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[LOWER[data] if lower else data] * power[:n], out=total[1:])
    ids = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(first, len(offsets) - 1, data, offsets, starts, ends, ids, row, bounds)


def segments(column: pa.Array, lower: bool, size: int = SEGMENT, separator: np.ndarray = SEPARATOR) -> Iterator[Words]:
    """The column's words, some rows at a time, so that the arrays stay small."""
    data, offsets = text_bytes(column)
    at, rows = 0, len(column)
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield scan(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], lower, at, separator)
        at = to


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the windows of ``n`` consecutive words, and the place of each one's first word."""
    m = len(words.ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total = total * _U(_M) + words.ids[j:j + m]
    whole = np.flatnonzero(words.row[:m] == words.row[n - 1:n - 1 + m])
    return mix(total[whole]), whole
