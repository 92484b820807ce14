"""What a Python worker keeps between batches: the last thing it built."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_kept: dict[str, object] = {}


def keep(key: str, make: Callable[[], T]) -> T:
    """The thing built under ``key``; building another one lets it go, so that a reused worker holds one at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
