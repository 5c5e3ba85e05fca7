"""Memory of Python workers, which Spark reuses from task to task and stage to
stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Hand memory that is free inside the worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def bounded(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` over a task's batches; when the task ends, however it ends, the
    caches that ``forget`` empties are dropped and free memory is given back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return task
