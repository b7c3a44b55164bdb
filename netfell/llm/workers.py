"""What a Python worker keeps between tasks.

Spark reuses Python workers for whatever comes next, so what one operator keeps would stay while all later ones run. A
worker keeps one thing at a time, and gives freed memory back to the system: large arrays, Arrow's included, are blocks
of their own, which go as soon as they are freed, and a task begins with the rest handed back.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_KEPT: dict = {}
#: Arrays of so many bytes are blocks of their own.
LARGE = 4 << 20
_MMAP_THRESHOLD = -3  # mallopt's number for it
_LIBC: list = []


def _libc():
    """The C library, told once about large blocks; None where it has no such settings."""
    if not _LIBC:
        name = ctypes.util.find_library("c")
        own = ctypes.CDLL(name) if name else None
        _LIBC.append(own if hasattr(own, "malloc_trim") and hasattr(own, "mallopt") else None)
        if _LIBC[0]:
            _LIBC[0].mallopt(_MMAP_THRESHOLD, LARGE)
            pa.set_memory_pool(pa.system_memory_pool())
    return _LIBC[0]


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    gc.collect()
    if own := _libc():
        own.malloc_trim(0)


def kept(key: tuple, make: Callable[[], T]) -> T:
    """The thing of this key, made where the worker does not have it; whatever else it kept goes first."""
    if key not in _KEPT:
        fresh()
        _KEPT[key] = make()
    else:
        trim()
    return _KEPT[key]


def fresh() -> None:
    """Let go of what earlier operators and tasks left."""
    _KEPT.clear()
    trim()
