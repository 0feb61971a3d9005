"""Memory of Python workers, which stay alive between tasks."""

from __future__ import annotations

import ctypes
import ctypes.util

import pyarrow as pa


def give_back() -> None:
    """Return what a finished task has freed to the system, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
