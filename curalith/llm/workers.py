"""What a Python worker remembers between tasks: one operator's memo at a time.

Workers are reused from task to task and from operator to operator, so memos
that outlive a task would add up.  Asking for another memo lets go of the last
one, and operators without a memo let go of it when they begin.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: list[tuple[Hashable, object]] = []


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on between groups."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def forget() -> None:
    if _held:
        _held.clear()
        gc.collect()
        tidy()


def remembered(key: Hashable, make: Callable[[], object]):
    """The memo of this key: the worker's last one if it has the same key, else a new one in its place."""
    if not _held or _held[0][0] != key:
        forget()
        _held.append((key, make()))
    return _held[0][1]
