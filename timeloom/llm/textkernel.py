"""Vectorised word positions and hashes over Arrow string columns (numpy only).

All documents of a block are handled at once on the raw UTF-8 bytes. A range of bytes is hashed
eight bytes at a time, each lane going through a finaliser together with all before it, so the
hash is no sum over its bytes and swapped or complementary parts do not cancel out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is a block of its own.
BLOCK_BYTES = 1_000_000
#: Bytes of a range up to which it is hashed and compared by lanes, all ranges side by side.
LANE_BYTES = 512

_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation, for terms.
BREAKS = SPACES.copy()
BREAKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

#: Letters, digits and marks (but for the apostrophe) of ASCII; 0 for all else.
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range [start, end)."""
    wide, size = _lanes(data), end - start
    value = mix((wide[start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _LENGTH))
    live, k = np.flatnonzero(size > 8), 8
    while len(live) and k < LANE_BYTES:
        rest = size[live] - k
        value[live] = mix((value[live] * _SHINGLE[0]) ^ (wide[start[live] + k] & _KEEP[np.minimum(rest, 8)]))
        live, k = live[rest > 8], k + 8
    for i in live.tolist():
        value[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return value


def same_ranges(a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, size: np.ndarray, padded: bool = False) -> np.ndarray:
    """Whether ``size`` bytes from ``start_a`` of ``a`` equal those from ``start_b`` of ``b``.

    ``padded``: b has eight bytes to spare at its end, so it need not be copied.
    """
    wide_a = _lanes(a)
    wide_b = wide_a if b is a else np.ndarray((len(b) - 7,), dtype="<u8", buffer=b, strides=(1,)) if padded else _lanes(b)
    same = ((wide_a[start_a] ^ wide_b[start_b]) & _KEEP[np.minimum(size, 8)]) == 0
    live, k = np.flatnonzero(same & (size > 8)), 8
    while len(live) and k < LANE_BYTES:
        rest = size[live] - k
        same[live] = ((wide_a[start_a[live] + k] ^ wide_b[start_b[live] + k]) & _KEEP[np.minimum(rest, 8)]) == 0
        live, k = live[same[live] & (rest > 8)], k + 8
    for i in live.tolist():
        same[i] = np.array_equal(a[start_a[i] : start_a[i] + size[i]], b[start_b[i] : start_b[i] + size[i]])
    return same


@dataclass
class Block:
    """Words of consecutive documents.

    ``first[d]:first[d + 1]`` are the words of document ``row0 + d``; ``start`` and ``end``
    are their byte ranges in ``data``, and ``hash`` their hashes. ``folded`` are the bytes that
    are hashed: those of ``data``, in lower case if case is folded.
    """

    row0: int
    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    folded: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix_hash(self, n_bytes: int) -> np.ndarray:
        """Hash of each word's beginning: of the whole characters among its first ``n_bytes`` bytes."""
        stop = np.minimum(self.end, self.start + n_bytes)
        inside = np.flatnonzero(stop < self.end)
        for _ in range(3):  # a character has at most three bytes after its first
            inside = inside[(self.data[stop[inside]] & 0xC0) == 0x80]
            stop[inside] -= 1
        return mix(hash_ranges(self.folded, self.start, np.maximum(stop, self.start)) + np.uint64(n_bytes))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.string():
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int32, count=n + 1, offset=4 * column.offset) if n else np.zeros(1, np.int32)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off.astype(np.int64)


def blocks(column: pa.Array, breaks: np.ndarray = SPACES, fold_case: bool = False, block_bytes: int = BLOCK_BYTES, split_marks: bool = False, fold_ascii_words: bool = False) -> Iterator[Block]:
    """The documents of a column, in blocks of about ``block_bytes``.

    ``split_marks``: words also end between an ASCII letter and an ASCII digit, and between
    either and an ASCII mark other than the apostrophe. ``fold_ascii_words``: case is folded in
    words without other characters alone, as others may compose differently in either case.
    """
    data, off = string_buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + block_bytes, side="right")) - 1)
        yield _block(row, data[off[row] : off[stop]], off[row : stop + 1] - off[row], breaks, fold_case, split_marks, fold_ascii_words)
        row = stop


def _block(row0: int, data: np.ndarray, off: np.ndarray, breaks: np.ndarray, fold_case: bool, split_marks: bool = False, fold_ascii_words: bool = False) -> Block:
    n = len(data)
    inside = ~breaks[data]
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        heads = off[:-1][off[:-1] < off[1:]]
        before[heads] = False
        after[heads[1:] - 1] = False
        if split_marks:
            kind = _KIND[data]
            turn = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
            before[turn] = False
            after[turn - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    folded = _FOLD[data] if fold_case else data
    if fold_ascii_words and (high := data >= 128).any():
        seen = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(high, out=seen[1:])
        wide = np.flatnonzero(seen[end] > seen[start])
        edge = np.zeros(n + 1, dtype=np.int8)
        edge[start[wide]] = 1
        edge[end[wide]] -= 1
        folded = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, data, folded)
    return Block(row0, data, off, start, end, np.searchsorted(start, off), hash_ranges(folded, start, end), folded)


def shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word windows, and where each document's windows begin.

    A document of fewer words than ``width`` (but at least one) has one window of them all.
    """
    counts = block.counts()
    per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(per_doc, out=first[1:])
    position = np.arange(first[-1]) + np.repeat(block.first[:-1] - first[:-1], per_doc)
    size = np.repeat(np.minimum(counts, width), per_doc)
    total = np.zeros(len(position), dtype=np.uint64)
    short = bool((counts < width).any())
    last = len(block.hash) - 1
    for k in range(width):
        part = block.hash[np.minimum(position + k, last)] * (_SHINGLE[k % 5] + np.uint64(2 * (k // 5)))
        total += np.where(size > k, part, np.uint64(0)) if short else part
    return mix(total + size.astype(np.uint64)), first


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
