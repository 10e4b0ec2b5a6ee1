"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns the memory that a task's arrays have left with the allocators to the system.

    A Python worker lives on for later tasks and stages; what it keeps counts
    against its executor all the while.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
