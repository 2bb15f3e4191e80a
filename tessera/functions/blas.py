"""Linear algebra on one thread where Spark's tasks are the parallel part; elsewhere its threads stay as they are."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

#: Prefix and suffix of the functions by which builds of OpenBLAS tell and set their threads: fixed values.
NAMES = (("scipy_openblas_", "64_"), ("openblas_", "64_"), ("scipy_openblas_", ""), ("openblas_", ""))


@cache
def _libraries() -> list[tuple]:
    """(threads now, set threads) of each OpenBLAS that this process has loaded."""
    import numpy  # noqa: F401

    found = []
    if not os.path.exists("/proc/self/maps"):
        return found
    with open("/proc/self/maps") as f:
        paths = {line.split()[-1] for line in f if "openblas" in line}
    for path in sorted(paths):
        with suppress(OSError):
            lib = ctypes.CDLL(path)
            for before, after in NAMES:
                if hasattr(lib, f"{before}set_num_threads{after}") and hasattr(lib, f"{before}get_num_threads{after}"):
                    found.append((getattr(lib, f"{before}get_num_threads{after}"), getattr(lib, f"{before}set_num_threads{after}")))
                    break
    return found


@contextmanager
def one_thread() -> Iterator[None]:
    """Within this block linear algebra runs on one thread; what was set before comes back."""
    before = [get() for get, _ in _libraries()]
    for _, put in _libraries():
        put(1)
    try:
        yield
    finally:
        for (_, put), n in zip(_libraries(), before, strict=True):
            put(n)
