"""Keep the Python workers small.

Spark reuses a worker process for later tasks, of later stages and queries too,
so what one task leaves behind (caches, freed but unreturned heap) adds up to
memory of the executor.  ``freed`` wraps the function of a ``mapInArrow``: when its
task ends, well or not, registered caches are emptied and free heap goes back to
the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_emptied: list[Callable[[], None]] = []


def at_task_end(clear: Callable[[], None]) -> None:
    """Call ``clear`` at the end of every task of this worker process."""
    _emptied.append(clear)


def give_back() -> None:
    for clear in _emptied:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to trim
        pass


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
