"""Giving memory back at the end of a task: Python workers are used again by other stages."""

from __future__ import annotations

import ctypes
import gc


def give_back() -> None:
    """Collect garbage and return freed memory to the system where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
