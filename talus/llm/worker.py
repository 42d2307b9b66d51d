"""What a Python worker remembers between tasks, given up when another operator's task runs in it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_owner: str | None = None
_drops: dict[str, Callable[[], None]] = {}


def remembers(owner: str, drop: Callable[[], None]) -> None:
    """Registers how to give up what an operator remembers."""
    _drops[owner] = drop


def _tune() -> None:
    """Large arrays get pages of their own, which go back to the system when they are freed."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise rises with use
    except (OSError, AttributeError):
        pass


def trim() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def claim(owner: str) -> None:
    """The worker is the owner's from now on: all others forget."""
    global _owner
    if _owner == owner:
        return
    if _owner is None:
        _tune()
    _owner = owner
    for name, drop in _drops.items():
        if name != owner:
            drop()
    trim()
