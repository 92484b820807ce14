"""Text columns in Arrow functions, some rows at a time.

A batch has up to 10,000 texts. As Python strings they take four bytes a
character as soon as one of it is an emoji, so only a slice of them is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text held as Python strings; a longer text is a slice of its own


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows with about ``size`` bytes of a text column."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + size, "right")) - 1)
        yield at, to
        at = to


def map_texts(column: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``change`` of each text; nulls stay null."""
    parts = [pa.array([None if t is None else change(t) for t in column.slice(a, b - a).to_pylist()], column.type) for a, b in slices(column)]
    return pa.concat_arrays(parts) if parts else column
