"""Python workers serve stages of many kinds, one after another: what a stage keeps for its next task goes when another
kind begins, and memory that is free goes back to the machine when a task ends."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What clears the things kept for a kind of stage.
_kept: dict[str, Callable[[], None]] = {}


def keeps(kind: str, clear: Callable[[], None]) -> None:
    """Stages of a kind keep something between tasks that ``clear`` lets go."""
    _kept[kind] = clear


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def task(kind: str | None = None) -> Callable:
    """A function on the batches of a task, of a kind that keeps something or of none."""

    def of(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
        @functools.wraps(f)
        def run(batches: Iterator[pa.RecordBatch], *args: object) -> Iterator[pa.RecordBatch]:
            for other, clear in _kept.items():
                if other != kind:
                    clear()
            try:
                yield from f(batches, *args)
            finally:
                _give_back()

        return run

    return of
