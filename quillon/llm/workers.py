"""Memory of a Python worker process, which Spark uses again for other tasks and operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_HELD: dict[str, Callable[[], None]] = {}

Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Gives free memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # only a hint to the allocator


def claim(name: str, drop: Callable[[], None]) -> None:
    """Says that an operator's tables are in use, and empties those that other operators left in this process."""
    if set(_HELD) - {name}:
        for other in [x for x in _HELD if x != name]:
            _HELD.pop(other)()
        trim()
    _HELD[name] = drop


def _nothing() -> None:
    """For operators that keep no tables."""


def lean(run: Callable[[Batches], Batches], name: str = "lean") -> Callable[[Batches], Batches]:
    """A function over batches that leaves an idle worker small: what a task has used is given back at its end.

    ``name`` is that of the operator's own ``claim``; without one, tables of other operators are emptied first.
    """

    def task(batches: Batches) -> Batches:
        if name == "lean":
            claim("lean", _nothing)
        try:
            yield from run(batches)
        finally:
            trim()

    return task
