"""What Python workers keep when a task ends: they live on, and so does what they hold."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

#: A function for ``mapInArrow``.
Mapped = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What later tasks of a function may use again, by the function's own key.
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """``make()``, or what it made in an earlier task of this worker."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def let_go(but: Hashable | None = None) -> None:
    """Drop what is kept, except for what has this key."""
    gone = [k for k in _KEPT if k != but]
    for key in gone:
        del _KEPT[key]
    if gone:
        give_back()


def give_back() -> None:
    """Return to the system the freed memory that Arrow and malloc hold for later use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def tidy(run: Mapped, key: Hashable | None = None) -> Mapped:
    """The function, which drops first what others keep (all but ``key``) and gives back freed memory at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(key)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
