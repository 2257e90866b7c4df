"""What a Python worker keeps between tasks: one large object, so that operators after each other don't add up."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The object of this key; making it lets go of any other."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def free() -> None:
    """Let go of the object that is held; for operators that need none."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system; the C library keeps it otherwise, for as long as the worker lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
