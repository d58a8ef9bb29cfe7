"""Python workers are reused: what one operator keeps in a worker goes when another one starts there."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_owner: list[str] = []
_drops: dict[str, Callable[[], None]] = {}


def start(name: str, drop: Callable[[], None] | None = None) -> None:
    """Called by an operator's function in a worker; drop empties what it keeps."""
    if drop is not None:
        _drops[name] = drop
    if _owner == [name]:
        return
    for other, f in _drops.items():
        if other != name:
            f()
    _owner[:] = [name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: nothing to give back
