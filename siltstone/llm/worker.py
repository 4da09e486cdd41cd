"""What a Python worker keeps from task to task: one thing at a time, so that its memory stays bounded.

Spark reuses its Python workers.  A cache that one operator fills would stay while the worker runs the
tasks of others, so whoever asks for another thing, or for none, drops the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa

_HELD: dict[Hashable, object] = {}


def kept(name: Hashable, make: Callable[[], object]):
    """The thing of this name, made if this worker does not hold it; any other is dropped."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def light() -> None:
    """Hold nothing, and hand back memory that Arrow keeps in reserve."""
    if _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
