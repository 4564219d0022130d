"""Ids of byte ranges that recur: encoded once, found by hash, verified byte by byte."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from timeloom.llm.textkernel import same_ranges

#: Turns the numbers of some ranges into all their ids in one array, and the number of each.
Learn = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class _Growing:
    """An array that is appended to; room is doubled when it runs out."""

    def __init__(self, dtype: type, spare: int = 0):
        self.spare, self.n = spare, 0
        self.room = np.zeros(1 << 12, dtype)

    def append(self, values: np.ndarray) -> None:
        need = self.n + len(values) + self.spare
        if need > len(self.room):
            room = np.zeros(max(need, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


#: Bits of a hash that name its slot.
SLOT_BITS = 20


class IdPool:
    """Ranges of bytes and their ids, appended to flat arrays and found by hash.

    A table of ``1 << SLOT_BITS`` slots, by the first bits of the hash, holds the first range that came to
    each; ranges whose slot holds another are found in an index sorted by hash.

    A pool of more than ``max_keys`` ranges or ``max_bytes`` bytes is emptied, which costs time
    but changes no result.
    """

    def __init__(self, dtype: type, max_keys: int = 700_000, max_bytes: int = 32 << 20):
        self.dtype, self.max_keys, self.max_bytes = dtype, max_keys, max_bytes
        self.reset()

    def reset(self) -> None:
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.text = _Growing(self.dtype), _Growing(np.uint8, spare=8)
        self.begin, self.size, self.text_begin, self.text_size = (_Growing(np.int64) for _ in range(4))
        self.slots, self.hash = np.full(1 << SLOT_BITS, -1, np.int32), _Growing(np.uint64)

    def _add(self, key: np.ndarray, flat: np.ndarray, size: np.ndarray, texts: list[bytes]) -> None:
        at, rows = np.searchsorted(self.key, key), np.arange(self.size.n, self.size.n + len(key), dtype=np.int32)
        self.key, self.row = np.insert(self.key, at, key), np.insert(self.row, at, rows)
        slot = _slot(key)
        free = np.flatnonzero(self.slots[slot] < 0)
        self.slots[slot[free]] = rows[free]
        self.hash.append(key)
        length = np.array([len(t) for t in texts], np.int64)
        self.begin.append(self.ids.n + np.cumsum(size) - size)
        self.text_begin.append(self.text.n + np.cumsum(length) - length)
        self.size.append(size)
        self.text_size.append(length)
        self.ids.append(flat)
        self.text.append(np.frombuffer(b"".join(texts), np.uint8))

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, learn: Learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the ranges in turn, where each range's ids end (from 0 on), and which ranges are wrong.

        A range is wrong if another one, whose bytes differ, has its hash; what stands for it
        is then that one's ids, and the caller has to encode it in another way.
        """
        if not len(key):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, bool)
        if len(self.key) > self.max_keys or self.text.n > self.max_bytes:
            self.reset()
        row = self.slots[_slot(key)]
        miss = np.flatnonzero((row < 0) | (self.hash.room[row] != key))
        if len(miss):
            distinct, seen, which = np.unique(key[miss], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.key, distinct), max(len(self.key) - 1, 0))
            new = np.flatnonzero(self.key[at] != distinct) if len(self.key) else np.arange(len(distinct))
            if len(new):
                raw, rows = data.tobytes(), miss[seen[new]]
                flat, size = learn(rows)
                self._add(distinct[new], flat, size, [raw[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist(), strict=True)])
                at = np.searchsorted(self.key, distinct)
            row[miss] = self.row[at][which]
        length, held = end - start, self.text_size.room[row]
        wrong = (held != length) | ~same_ranges(data, start, self.text.room[: self.text.n + 8], self.text_begin.room[row], np.minimum(length, held), padded=True)
        size = self.size.room[row]
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.ids.room[np.repeat(self.begin.room[row] - ends[:-1], size) + np.arange(ends[-1])], ends, wrong


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SLOT_BITS)).view(np.int64)
