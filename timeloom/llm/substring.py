"""Repeated passages across documents, found with compact windows of min-hashed n-grams."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.support import cut, free_name, join_checked, join_lists_checked, written
from timeloom.llm.textkernel import as_signed, blocks, mix, shingles
from timeloom.llm.workers import tidy

#: Words of an n-gram, the tokens of the windows.
WIDTH = 5
#: n-grams of one block of a window's sketch, and blocks to each side.
STEP, SIDE = 6, 8
#: Words by which inserted and deleted words may shift the parts of one passage: with a
#: similarity of 0.8, at most 12 in 50.
REACH = 16
#: n-grams of agreeing blocks that make two documents worth laying over each other word by word.
HINT = 2 * STEP
#: Words of a tile, in which the words of earlier documents are handed out.
TILE = 32
#: First windows of a signature that one task holds; those of a more varied one are dealt out by their keys.
MOST_HEADS = 1 << 14
#: Low bits of a signature that tell its hash function.
_FUNCTIONS = 15
#: n-grams handled at once (windows of a longer text overlap at the seams).
SEGMENT = 1 << 23

_WINDOW_FIELDS = ["value", "doc_id", "at", "step", "times", "left", "right", "s0", "s1", "s2", "s3"]
#: Windows as they are shuffled: ``place`` is at, left and right, ``series`` step and times less one, each packed
#: into one number, in whose order the windows of a document come.
_PACKED_FIELDS = ["value", "doc_id", "place", "series", "s0", "s1", "s2", "s3"]
_WINDOW_SCHEMA = ", ".join(f"{f} long" for f in _PACKED_FIELDS)


def _pack(at: np.ndarray, step: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds are at most ``SIDE`` * ``STEP``, so eight bits hold one."""
    return (at << 16) | (left << 8) | right, (step << 31) | (times - 1)


def _unpack(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of ``_WINDOW_FIELDS``."""
    value, doc, place, series, *sketch = (batch.column(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in _PACKED_FIELDS)
    return np.stack([value, doc, place >> 16, series >> 31, (series & ((1 << 31) - 1)) + 1, (place >> 8) & 255, place & 255, *sketch], axis=1)


def window_minima(key: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Positions that hold the least key of some window of ``length`` keys within a document.

    ``key`` must hold no equal keys. These are the roots of all subtrees of at least ``length``
    keys in the documents' Cartesian trees.
    """
    n = len(key)
    if n < length:
        return key[:0]
    least, span = key.copy(), 1
    while span < length:
        hop = min(span, length - span)
        least = np.minimum(least[: len(least) - hop], least[hop:])
        span += hop
    valid = np.zeros(len(least) + 1, dtype=np.int32)
    sizes = np.diff(first)
    begin = first[:-1][sizes >= length]
    stop = first[1:][sizes >= length] - length + 1
    np.add.at(valid, begin, 1)
    np.add.at(valid, stop, -1)
    least = least[np.cumsum(valid[:-1]) > 0]
    if not len(least):
        return least
    changed = np.concatenate([[True], least[1:] != least[:-1]])
    return least[changed]


def compact_windows(value: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right) of every compact window of at least ``length`` tokens.

    All token subsequences that begin in [left, centre] and end in [centre, right] have the
    centre's value as their min-hash. A window is a subtree of its document's Cartesian tree;
    the neighbours that bound it are centres themselves, so one stack over the centres finds
    both bounds. Of equal values the leftmost counts as the least.
    """
    centres, lefts, rights = [], [], []
    for seam in range(0, max(1, len(value)), SEGMENT):
        part = value[seam : seam + SEGMENT + length]
        low = np.uint64((1 << 24) - 1)
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        inner = np.unique(np.clip(first - seam, 0, len(part)))
        least = window_minima(key, inner, length)
        at = (least & low).astype(np.int64)
        if not len(at):
            continue
        doc = np.searchsorted(inner, at, side="right") - 1
        left, right = inner[doc].copy(), inner[doc + 1] - 1
        keys, docs, ats = least.tolist(), doc.tolist(), at.tolist()
        stack: list[int] = []
        lo, hi = left.tolist(), right.tolist()
        for i, k in enumerate(keys):
            d = docs[i]
            if stack and docs[stack[-1]] != d:
                stack = []
            while stack and keys[stack[-1]] > k:
                hi[stack.pop()] = ats[i] - 1
            if stack:
                lo[i] = ats[stack[-1]] + 1
            stack.append(i)
        centres.append(at + seam)
        lefts.append(np.array(lo) + seam)
        rights.append(np.array(hi) + seam)
    if not centres:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in (centres, lefts, rights))


def _sketch(grams: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Four longs of four 16-bit block hashes: right blocks from the centre, then left ones.

    A block of ``STEP`` n-grams is told by its first and last n-gram, which hold all its words.
    The centre is in the first block of either side, so that of any 46 n-grams around it block
    edges cut off five and never more. Blocks that leave the document are 0 and match nothing.
    """
    packed = np.zeros((len(at), 2 * SIDE), dtype=np.uint16)
    for k in range(SIDE):
        for column, begin in ((k, at + k * STEP), (SIDE + k, at - (k + 1) * STEP + 1)):
            end = begin + STEP - 1
            inside = (begin >= low) & (end < high)
            b, e = np.where(inside, begin, at), np.where(inside, end, at)
            packed[:, column] = np.where(inside, (mix(grams[b] * np.uint64(3) + grams[e]) >> np.uint64(48)).astype(np.uint16) | np.uint16(1), 0)
    return packed.view(np.int64)


def _fold_repeats(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, step, times): windows with equal keys at evenly spaced places become one row.

    A text that repeats a word or a line over and over has a window at every turn, all with one
    value and one sketch. ``row`` is the first of each series, in place of all its members.
    """
    order = np.argsort(key, kind="stable")
    k, place = key[order], at[order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    if not same.any():
        return np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
    head, step, times = [], [], []
    for i, (again, p) in enumerate(zip(same.tolist(), place.tolist(), strict=True)):
        if again and (times[-1] == 1 or p - last == step[-1]):
            step[-1] = p - last
            times[-1] += 1
        else:
            head.append(i)
            step.append(0)
            times.append(1)
        last = p
    row, step, times = order[head], np.array(step), np.array(times)
    back = np.argsort(row)
    return row[back], step[back], times[back]


def _windows(length: int, hashes: int):
    seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                grams, first = shingles(block, WIDTH)
                for number, seed in enumerate(seeds):
                    value = (mix(grams ^ seed) & ~np.uint64(_FUNCTIONS)) | np.uint64(number)
                    at, left, right = compact_windows(value, first, length)
                    doc = np.searchsorted(first, at, side="right") - 1
                    sketch = _sketch(grams, at, first[doc], first[doc + 1])
                    weight = mix(np.arange(1, 5, dtype=np.uint64))
                    row, step, times = _fold_repeats(mix((sketch.view(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + value[at] + doc.astype(np.uint64)), at)
                    # What series agree on is told by their sketches, so the bounds of one are no bound.
                    reach = SIDE * STEP
                    left, right = (np.where(times > 1, reach, np.minimum(x[row], reach)) for x in (at - left, right - at))
                    at, doc, sketch = at[row], doc[row], sketch[row]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(as_signed(value[at])), pa.array(ids[block.row0 + doc].astype(np.int64)),
                            *(pa.array(x.astype(np.int64)) for x in _pack(at - first[doc], step, times, left, right)),
                            *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)),
                        ],
                        names=_PACKED_FIELDS,
                    )

    return run


def _filled(grams: int) -> int:
    """Blocks that a passage of ``grams`` n-grams fills around any centre in it."""
    return min((grams + 1 - (STEP - 1)) // STEP, 2 * SIDE)


def _splits(grams: int) -> list[tuple[int, int]]:
    """(right, left) blocks that such a passage fills, for each way in which it may lie."""
    filled = _filled(grams)
    return [(filled - k, k) for k in range(max(0, filled - SIDE), min(filled, SIDE) + 1)]


def _masks(grams: int) -> list[tuple[int, int, int, int]]:
    """Which bits of a sketch's four longs have to agree, for each kind of partner.

    None at all; the nearest four blocks to the right, to the left; the nearest two on both
    sides; and, for each of :func:`_splits`, all blocks that are filled.
    """

    def side(k: int) -> tuple[int, int]:
        return (1 << 16 * min(k, 4)) - 1, (1 << 16 * max(k - 4, 0)) - 1

    return [(*side(r), *side(l)) for r, l in [(0, 0), (4, 0), (0, 4), (2, 2), *_splits(grams)]]


def _intervals(rows: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(doc_id, low, high, ref_doc_id, shift) of runs of blocks in which windows agree with their partners."""
    column = {f: rows[:, k] for k, f in enumerate(_WINDOW_FIELDS)}
    packed = np.ascontiguousarray(rows[:, -4:]).view(np.uint16).reshape(-1, 2 * SIDE)
    mine = packed[own]
    equal = (mine == packed[other]) & (mine != 0)
    # Left blocks from the farthest to the nearest, then right blocks.
    edge = np.zeros((len(own), 2 * SIDE + 2), dtype=np.int8)
    edge[:, 1:-1] = np.concatenate([equal[:, SIDE:][:, ::-1], equal[:, :SIDE]], axis=1)
    turn = np.diff(edge, axis=1)
    row, begin = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    a, b = own[row], other[row]
    low = np.maximum((begin - SIDE) * STEP + (begin < SIDE), -np.minimum(column["left"][a], column["left"][b]))
    high = np.minimum((end - SIDE) * STEP - (end > SIDE), np.minimum(column["right"][a], column["right"][b]))
    keep = high >= low
    a, b, low, high = a[keep], b[keep], low[keep], high[keep]
    at, shift, step, times = column["at"][a], column["at"][b] - column["at"][a], column["step"][a], column["times"][a]
    low, high = at + low, at + high
    dense = step <= high - low + 1
    high = high + np.where(dense, step * (times - 1), 0)
    each = np.where(dense, 1, times)
    moved = np.repeat(step, each) * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    doc, low, high, ref, shift = (np.repeat(x, each) for x in (column["doc_id"][a], low, high, column["doc_id"][b], shift))
    return np.unique(np.stack([doc, low + moved, high + moved, ref, shift - moved], axis=1), axis=0)


def _mask_keys(rows: np.ndarray, masks: list[tuple[int, int, int, int]]) -> np.ndarray:
    """For each mask, a hash of each row's signature and of the blocks that the mask asks for."""
    value, sketch = rows[:, 0].astype(np.uint64), np.ascontiguousarray(rows[:, -4:]).view(np.uint64)
    weight = mix(np.arange(11, 15, dtype=np.uint64))
    out = np.empty((len(masks), len(rows)), dtype=np.uint64)
    for k, mask in enumerate(masks):
        out[k] = mix(value + (mix(sketch & np.array(mask, dtype=np.uint64)) * weight).sum(axis=1, dtype=np.uint64) + np.uint64(k))
    return out


def _undecided(rows: np.ndarray, own: np.ndarray, other: np.ndarray, kind: np.ndarray, grams: int) -> np.ndarray:
    """(doc_id, at, left blocks) of windows whose first partner may not hold all that they share with a later one.

    A passage of ``grams`` n-grams fills some blocks around the centre and ends within the next
    one on either side. A partner that agrees in these two as well holds whatever passage
    another window of the group shares here. One that does not leaves it open. One hash function
    is enough for this, since a passage that is shared word for word has a window for each.
    """
    spots, first = _splits(grams), len(_masks(grams)) - len(_splits(grams))
    some = (kind >= first) & (own != other) & ((rows[own, 0] & _FUNCTIONS) == 0)
    own, other, kind = own[some], other[some], kind[some] - first
    packed = np.ascontiguousarray(rows[:, -4:]).view(np.uint16).reshape(-1, 2 * SIDE)
    equal = np.zeros((len(own), 2 * SIDE + 1), dtype=bool)  # the last column stands for blocks beyond the sketch
    equal[:, :-1] = (packed[own] == packed[other]) & (packed[own] != 0)
    right = np.array([r if r < SIDE else 2 * SIDE for r, _ in spots])[kind]
    left = np.array([SIDE + n if n < SIDE else 2 * SIDE for _, n in spots])[kind]
    line = np.arange(len(own))
    open_ = ~(equal[line, right] & equal[line, left])
    column = {f: k for k, f in enumerate(_WINDOW_FIELDS)}
    own = own[open_]
    return np.unique(np.stack([rows[own, column["doc_id"]], rows[own, column["at"]], np.array([n for _, n in spots])[kind[open_]]], axis=1), axis=0)


#: Kinds of rows that windows leave behind: an interval in which two documents agree, a window whose
#: partner is undecided, and a window of a signature that one task does not take in.
_INTERVAL, _SPOT, _LEFT = 0, 1, 2
_FOUND_FIELDS = [f"c{k}" for k in range(len(_PACKED_FIELDS))]
_FOUND_SCHEMA = ", ".join(["kind int", *(f"{f} long" for f in _FOUND_FIELDS)])


def _found(kind: int, values: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; columns that it has no use for are null."""
    n = len(values)
    columns = [pa.array(np.ascontiguousarray(values[:, k])) if k < values.shape[1] else pa.nulls(n, pa.int64()) for k in range(len(_FOUND_FIELDS))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *columns], names=["kind", *_FOUND_FIELDS])


def _repacked(rows: np.ndarray) -> np.ndarray:
    c = {f: rows[:, k] for k, f in enumerate(_WINDOW_FIELDS)}
    return np.stack([c["value"], c["doc_id"], *_pack(c["at"], c["step"], c["times"], c["left"], c["right"]), *(c[f"s{k}"] for k in range(4))], axis=1)


def _held_against(rows: np.ndarray, own: np.ndarray, other: np.ndarray, kind: np.ndarray, grams: int) -> Iterator[pa.RecordBatch]:
    """Intervals and undecided windows of pairs of rows, which met by mask ``kind`` (-1: as neighbours)."""
    spots = _undecided(rows, own, other, kind, grams)
    if len(spots):
        yield _found(_SPOT, spots)
    pair = np.unique(np.stack([own, other], axis=1)[rows[other, 1] < rows[own, 1]], axis=0)
    found = _intervals(rows, pair[:, 0], pair[:, 1])
    if len(found):
        yield _found(_INTERVAL, found)


def _meetings(grams: int, most: int = MOST_HEADS):
    """Reads windows sorted by signature and order; yields intervals of each with its partners.

    A partner is the window before in order, or the first one of the signature that agrees in
    the blocks of one of :func:`_masks`. First ones are looked up in a table that fresh rows alone touch,
    so time is linear in the windows. Of a signature with more than ``most`` first ones, these and all
    windows that follow are passed on (:func:`_met_by_key`), so memory is bounded.
    """
    masks = _masks(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, len(_WINDOW_FIELDS)), dtype=np.int64)
        kept, last, known, passed = none, none, {}, False
        for batch in batches:
            fresh = _unpack(batch)
            if not len(fresh):
                continue
            before = len(kept) + len(last)
            rows = np.concatenate([kept, last, fresh])
            # The rows that go on with the last batch's signature.
            on = int(np.searchsorted(fresh[:, 0] != last[0, 0], True)) if len(last) else 0
            skip = on if passed else 0
            if skip:
                yield _found(_LEFT, _repacked(fresh[:skip]))
            if on < len(fresh):
                passed = False
            place = np.arange(max(1, before), len(rows))
            place = place[rows[place, 0] == rows[place - 1, 0]]
            owns, others, kinds = [place], [place - 1], [np.full(len(place), -1)]
            head, names = np.zeros(len(rows), dtype=bool), []
            ends = fresh[:, 0] == fresh[-1, 0]
            for k, key in enumerate(_mask_keys(fresh[skip:], masks)):
                each, first, which = np.unique(key, return_index=True, return_inverse=True)
                target = first + skip + before
                if known:
                    for u in np.flatnonzero(first + skip < on).tolist():
                        target[u] = known.get(int(each[u]), target[u])
                new = target >= before
                head[target[new]] = True
                mine = new & ends[first + skip]
                names.append((each[mine], target[mine]))
                owns.append(np.arange(skip, len(fresh)) + before)
                others.append(target[which])
                kinds.append(np.full(len(fresh) - skip, k))
            yield from _held_against(rows, *map(np.concatenate, (owns, others, kinds)), grams)
            if on < len(fresh):
                kept, known = none, {}
            if not passed:
                own = np.flatnonzero(head[before:] & ends) + before
                for each, target in names:
                    known.update(zip(each.tolist(), (np.searchsorted(own, target) + len(kept)).tolist(), strict=True))
                kept = np.concatenate([kept, rows[own]])
                if len(kept) > most:
                    yield _found(_LEFT, _repacked(kept))
                    kept, known, passed = none, {}, True
            last = fresh[-1:]

    return run


def _against_heads(grams: int):
    """Reads windows beside the first of their signature that agrees in the blocks of a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _unpack(batch)
            head = _unpack(pa.RecordBatch.from_arrays([batch.column("value"), *(batch.column(f"h_{f}") for f in _PACKED_FIELDS[1:])], names=_PACKED_FIELDS))
            n = len(own)
            yield from _held_against(np.concatenate([own, head]), np.arange(n), np.arange(n) + n, batch.column("mask").to_numpy().astype(np.int64), grams)

    return run


def _met_by_key(left: DataFrame, grams: int) -> DataFrame:
    """Intervals and undecided windows of signatures that are too varied for one task.

    Windows are dealt out by signature and mask: the first of each such key is a minimum, which is taken
    before the shuffle too, and the join that hands it back is one that adaptive execution splits.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64("value", F.lit(k), *(F.col(f"s{i}").bitwiseAND(F.lit(signed(m)).cast("long")) for i, m in enumerate(mask))) for k, mask in enumerate(_masks(grams))]
    rows = left.select("*", F.posexplode(F.array(*keys)).alias("mask", "key"))
    heads = rows.groupBy("mask", "key").agg(F.min(F.struct(*_PACKED_FIELDS[1:])).alias("head"))
    beside = rows.join(heads.select("mask", "key", *(F.col(f"head.{f}").alias(f"h_{f}") for f in _PACKED_FIELDS[1:])), ["mask", "key"])
    return beside.drop("key").mapInArrow(tidy(_against_heads(grams)), _FOUND_SCHEMA)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 and so on, modulo 2**64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _ranges(grams: int):
    """A hash of every range of ``grams`` n-grams that may be a passage around an undecided window's centre."""
    spare = grams + 1 - STEP * _filled(grams)
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots = batch.column("doc_id").to_numpy(), batch.column("spots").to_pylist()
            for block in blocks(batch.column("text")):
                values, first = shingles(block, WIDTH)
                if not len(values):
                    continue
                power, inverse = (_powers(b, len(values)) for b in (base, back))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)])
                asked = [(d, s["at"], s["blocks"]) for d in range(len(block)) for s in spots[block.row0 + d]]
                if not asked:
                    continue
                d, at, n = np.array(asked, dtype=np.int64).T
                out = []
                for left in range(max(0, spare - STEP + 1), min(spare, STEP - 1) + 1):
                    low = first[d] + at - (STEP * n + left - 1)
                    ok = (low >= first[d]) & (low + grams <= first[d + 1])
                    a = low[ok]
                    out.append(np.stack([as_signed(mix((total[a + grams] - total[a]) * inverse[a])), ids[block.row0 + d[ok]], a - first[d[ok]]], axis=1))
                rows = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["key", "doc_id", "low"])

    return run


def _decided(documents: DataFrame, spots: DataFrame, grams: int) -> DataFrame:
    """Intervals of ``grams`` n-grams of undecided windows with the first document that holds the same.

    All ranges of that length that may be meant are hashed as a whole, so the first document
    with an equal hash holds the passage.
    """
    asked = spots.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "blocks")).alias("spots"))
    texts = join_lists_checked(documents.select("doc_id", "text"), asked, "doc_id")
    ranges = written(texts.mapInArrow(tidy(_ranges(grams)), "key long, doc_id long, low long"))
    heads = ranges.groupBy("key").agg(F.min(F.struct("doc_id", "low")).alias("head"))
    met = ranges.join(heads, "key").where(F.col("head.doc_id") < F.col("doc_id"))
    return met.select("doc_id", "low", (F.col("low") + grams - 1).alias("high"), F.col("head.doc_id").alias("ref_doc_id"), (F.col("head.low") - F.col("low")).alias("shift"))


def repeated_passages(documents: DataFrame, *, min_words: int = 50, similarity: float = 0.8, hashes: int = 3) -> DataFrame:
    """(doc_id, start_word, n_words, ref_doc_id, ref_start_word) of passages that an earlier document holds.

    A passage of at least ``min_words`` words is reported in every document but that with the
    least doc_id among those that share it. Documents without one give no row.

    1. For each of ``hashes`` hash functions, the compact windows of at least
       ``min_words`` - 4 five-word n-grams are shuffled on their min-hash. Any two documents
       that share such a passage word for word share a window for each function; passages of
       similarity 0.8 share one with a probability of at least 0.8 for each.
    2. Windows with equal signatures meet in a sort on (signature, doc_id). Each is held against
       the first window of its signature, the one before it, and the first windows of
       those that agree with it in the blocks to its right, to its left, or next to it on both
       sides, or in all blocks that a passage of the least length fills, for each way in which it
       may lie around the centre. Where that first window parts from another within the next
       block, it may not hold all of a passage that others share. Of such windows (those of one hash function)
       all ranges of ``min_words`` words around the centre are hashed as a whole, and the first
       document with the same range is a partner too. So every passage that is shared word for
       word meets an earlier document that holds all of it, however common runs inside it are. No pairs within a
       signature are listed, and none are dropped. A signature with more than ``MOST_HEADS``
       windows of different surroundings is dealt out over tasks by signature and blocks.
    3. The windows of a pair are laid over each other at their centres. The stretch within both
       is compared block by block, and agreeing blocks become intervals. Intervals of a pair of
       documents with like shifts become stretches; those of ``HINT`` n-grams or more are looked into.
    4. The words of both documents around a stretch are laid over each other at every shift that
       edits may cause. Runs of five equal words or more are chained, and a chain counts if
       ``similarity`` of its n-grams agree, on the longer of its two sides, and it spans
       ``min_words`` words of the document.
    5. Of the passages of a document those inside another are left out. Passages that overlap
       otherwise are rows of their own, as each is held by its own ``ref_doc_id``.

    Edges of passages are exact: they begin and end with words that agree. A null or short text
    has no windows. Rows with a null doc_id are left out; rows that share a doc_id aren't held
    against each other.
    """
    if not 1 <= hashes <= _FUNCTIONS + 1:
        raise ValueError(f"hashes must be 1 to {_FUNCTIONS + 1}")
    grams = min_words - WIDTH + 1
    windows = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(_windows(grams, hashes)), _WINDOW_SCHEMA)
    ordered = windows.repartition("value").sortWithinPartitions("value", "doc_id", "place")
    found = written(ordered.mapInArrow(tidy(_meetings(grams)), _FOUND_SCHEMA))
    left = _of_kind(found, _LEFT, _PACKED_FIELDS)
    if not left.isEmpty():
        found = found.unionByName(written(_met_by_key(left, grams)))
    intervals = _of_kind(found, _INTERVAL, ["doc_id", "low", "high", "ref_doc_id", "shift"])
    spots = _of_kind(found, _SPOT, ["doc_id", "at", "blocks"])
    if not spots.isEmpty():
        intervals = intervals.unionByName(_decided(documents, spots, grams))
    return _verified(documents, _stretches(intervals, 2 * min_words), min_words, similarity)


def _of_kind(found: DataFrame, kind: int, names: list[str]) -> DataFrame:
    return found.where(F.col("kind") == kind).select(*(F.col(c).alias(name) for c, name in zip(_FOUND_FIELDS, names, strict=False)))


_STRETCH = ["ref_doc_id", "low", "high", "shift_low", "shift_high"]


def _stretches(intervals: DataFrame, gap: int) -> DataFrame:
    """Agreeing intervals of n-grams, united for each pair of documents and lane of shifts across gaps of up to ``gap``."""
    runs = _united(intervals.repartition("doc_id"), 0, "doc_id", "ref_doc_id", "shift")
    chained = _island(runs.withColumn("lane", F.floor(F.col("shift") / (2 * REACH))), gap, "doc_id", "ref_doc_id", "lane")
    united = chained.groupBy("doc_id", "ref_doc_id", "lane", "_island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("shift").alias("shift_low"), F.max("shift").alias("shift_high"))
    return united.where(F.col("high") - F.col("low") + 1 >= HINT).select("doc_id", *_STRETCH)


_PART_SCHEMA = "doc_id long, number int, tile int, words binary, stretch struct<ref_doc_id: long, low: long, high: long, shift_low: long, shift_high: long>"


def _word_parts(margin: int):
    """Word hashes, 32 bits each, of the stretches and tiles that are asked for of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, tiles = (batch.column(c).to_pylist() for c in ("doc_id", "spans", "tiles"))
            for block in blocks(batch.column("text")):
                rows = []
                for d in range(len(block)):
                    k = block.row0 + d
                    own = (block.hash[block.first[d] : block.first[d + 1]] >> np.uint64(32)).astype("<u4")
                    rows += [(ids[k], n, None, own[max(0, s["low"] - margin) : s["high"] + WIDTH + margin].tobytes(), s) for n, s in enumerate(spans[k] or ())]
                    rows += [(ids[k], None, t, own[t * TILE : (t + 1) * TILE].tobytes(), None) for t in tiles[k] or () if t * TILE < len(own)]
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.struct([(f, pa.int64()) for f in _STRETCH])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "number", "tile", "words", "stretch"])

    return run


def _runs(a: np.ndarray, b: np.ndarray, shifts: range) -> list[tuple[int, int, int]]:
    """(begin, end, shift) of all runs of at least ``WIDTH`` words in which a[i] equals b[i + shift]."""
    out = []
    at_once = max(1, (1 << 18) // max(1, len(a)))
    for k in range(0, len(shifts), at_once):
        some = shifts[k : k + at_once]
        # Rows are shifts; what lies outside b is -1 and equals nothing.
        line = np.full(len(a) + len(some) - 1, -1, dtype=np.int64)
        begin, end = max(0, some.start), min(len(b), some.start + len(line))
        if end > begin:
            line[begin - some.start : end - some.start] = b[begin:end]
        edge = np.zeros((len(some), len(a) + 2), dtype=np.int8)
        edge[:, 1:-1] = np.lib.stride_tricks.sliding_window_view(line, len(a)) == a.astype(np.int64)
        turn = np.diff(edge, axis=1)
        row, starts = np.nonzero(turn == 1)
        _, stops = np.nonzero(turn == -1)
        keep = stops - starts >= WIDTH
        out += zip(starts[keep].tolist(), stops[keep].tolist(), (row[keep] + some.start).tolist(), strict=True)
    return out


def _chain(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs in order on both sides: longer ones come first, others are trimmed to the room between them."""
    chain: list[tuple[int, int, int]] = []
    for begin, end, shift in sorted(runs, key=lambda r: (r[0] - r[1], abs(r[2]), r)):
        k = bisect.bisect_left(chain, (begin, end, shift))
        if k:
            before = chain[k - 1]
            begin = max(begin, before[1], before[1] + before[2] - shift)
        if k < len(chain):
            after = chain[k]
            end = min(end, after[0], after[0] + after[2] - shift)
        if end - begin >= WIDTH:
            chain.insert(k, (begin, end, shift))
    return chain


def passages_of(a: np.ndarray, b: np.ndarray, shifts: range, min_words: int, similarity: float) -> list[tuple[int, int, int]]:
    """(begin, words, begin in b) of the stretches of a that b holds, the longest first.

    A stretch goes from the head of one run of a chain to the end of another (or the same), at
    least ``similarity`` of the n-grams on its longer side are in runs, and it has at least
    ``min_words`` words of a.
    """
    chain = _chain(_runs(a, b, shifts))
    if not chain or chain[-1][1] - chain[0][0] < min_words:
        return []
    begin, end, shift = (np.array(c) for c in zip(*chain, strict=True))
    size = np.cumsum(np.concatenate([[0], end - begin - WIDTH + 1]))
    out, todo = [], [(0, len(chain))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        best, i, j = -1, -1, -1
        at_once = max(1, (1 << 18) // (hi - lo))
        for k in range(lo, hi, at_once):  # heads of stretches, a block of rows at a time
            heads = slice(k, min(hi, k + at_once))
            span = end[None, lo:hi] - begin[heads, None]
            ref = (end + shift)[None, lo:hi] - (begin + shift)[heads, None]
            held = size[None, lo + 1 : hi + 1] - size[heads, None]
            good = (span >= min_words) & (held >= similarity * (np.maximum(span, ref) - WIDTH + 1) - 1e-9)
            longest = np.where(good, span, -1)
            if longest.max() > best:
                best = int(longest.max())
                row, column = np.unravel_index(longest.argmax(), span.shape)
                i, j = k + int(row), lo + int(column)
        if best < 0:
            continue
        out.append((int(begin[i]), best, int(begin[i] + shift[i])))
        todo += [(lo, i), (j + 1, hi)]
    return out


def _looked_into(margin: int, min_words: int, similarity: float):
    """Reads parts sorted by stretch, the document's own before the tiles of the other, and yields passages."""

    def passages(doc: int, stretch: dict, own: set[bytes], tiles: dict[int, set[bytes]]) -> list[tuple]:
        if not own or not tiles:
            return []
        base, first, ref = max(0, stretch["low"] - margin), min(tiles), stretch["ref_doc_id"]
        moved = base - first * TILE
        shifts = range(stretch["shift_low"] + moved - REACH, stretch["shift_high"] + moved + REACH + 1)
        found = set()
        # Rows that share an id have texts of their own; each is held against each.
        for turn in range(max(map(len, tiles.values()))):
            b = np.frombuffer(b"".join(sorted(tiles[t])[min(turn, len(tiles[t]) - 1)] for t in sorted(tiles)), dtype="<u4")
            for words in own:
                found |= {(doc, base + x, n, ref, first * TILE + y) for x, n, y in passages_of(np.frombuffer(words, dtype="<u4"), b, shifts, min_words, similarity)}
        return sorted(found)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=_PASSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stretch, own, tiles, out = None, None, set(), {}, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "number", "tile", "words", "stretch")]
            for doc, number, tile, words, about in zip(*columns, strict=True):
                if (doc, number) != key:
                    out += passages(key[0], stretch, own, tiles) if key else []
                    key, stretch, own, tiles = (doc, number), None, set(), {}
                if tile is None:
                    stretch = about
                    own.add(words)
                else:
                    tiles.setdefault(tile, set()).add(words)
            if out:
                yield batch_of(out)
                out = []
        out = passages(key[0], stretch, own, tiles) if key else []
        if out:
            yield batch_of(out)

    return run


_PASSAGE = ["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word"]


def _verified(documents: DataFrame, stretches: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Passages from stretches, by the words of both documents.

    Each document is asked once for the words around its own stretches and for the tiles of
    ``TILE`` words that other documents' stretches need of it. A document that very many others
    repeat gives each of its tiles once; the join that hands them out is one that adaptive
    execution splits where one tile is asked for by many.
    """
    spans = cut(stretches.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*_STRETCH))).alias("spans")))
    found = spans.select("doc_id", F.posexplode("spans").alias("number", "span")).select("doc_id", "number", "span.*")
    first = F.floor(F.greatest(F.lit(0), F.col("low") + F.col("shift_low") - min_words - REACH) / TILE)
    last = F.floor(F.greatest(F.lit(0), F.col("high") + F.col("shift_high") + WIDTH + min_words + REACH) / TILE)
    asked = found.select("doc_id", "number", "ref_doc_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("tile"))
    tiles = asked.select(F.col("ref_doc_id").alias("doc_id"), "tile").distinct().groupBy("doc_id").agg(F.collect_list("tile").alias("tiles"))
    rows = join_lists_checked(documents.select("doc_id", "text"), spans.join(tiles, "doc_id", "full"), "doc_id")
    parts = written(rows.mapInArrow(tidy(_word_parts(min_words)), _PART_SCHEMA))
    given = parts.where("number is null").select(F.col("doc_id").alias("ref_doc_id"), "tile", "words")
    held = asked.join(given, ["ref_doc_id", "tile"]).select("doc_id", "number", "tile", "words", F.lit(None).cast(parts.schema["stretch"].dataType).alias("stretch"))
    both = parts.where("number is not null").select(held.columns).unionAll(held)
    ordered = both.repartition("doc_id", "number").sortWithinPartitions("doc_id", "number", F.asc_nulls_first("tile"))
    passages = ordered.mapInArrow(tidy(_looked_into(min_words, min_words, similarity)), ", ".join(f"{c} long" for c in _PASSAGE))
    # A passage inside another of the document adds nothing; of equal ones the earliest holder's stays.
    end = F.col("start_word") + F.col("n_words")
    before = Window.partitionBy("doc_id").orderBy("start_word", F.desc("n_words"), "ref_doc_id", "ref_start_word").rowsBetween(Window.unboundedPreceding, -1)
    return passages.withColumn("_outer", F.max(end).over(before)).where(F.col("_outer").isNull() | (end > F.col("_outer"))).select(*_PASSAGE)


def _island(intervals: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Number the intervals of equal keys by island; an island has no gap of more than ``gap``.

    ``_reach`` is the highest end of those before."""
    in_order = Window.partitionBy(*keys).orderBy("low", "high", "shift")
    marked = intervals.withColumn("_reach", F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_reach").isNull() | (F.col("low") > F.col("_reach") + gap + 1)
    return marked.withColumn("_island", F.sum(new.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))


def _united(intervals: DataFrame, gap: int, *keys: str) -> DataFrame:
    return _island(intervals, gap, *keys).groupBy(*keys, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def _cut(columns: list[str], name: str, min_left: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").cast(pa.binary()).to_pylist(), batch.column(name).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for block in blocks(batch.column("text")):
                for d in range(len(block)):
                    row = block.row0 + d
                    if not spans[row]:
                        continue
                    a, b = block.first[d], block.first[d + 1]
                    left = np.ones(b - a, dtype=bool)
                    for s in spans[row]:
                        left[s["start_word"] : s["start_word"] + s["n_words"]] = False
                    keep[row] = left.sum() >= min_left
                    edge = np.diff(np.concatenate([[1], left.astype(np.int8), [1]]))
                    text, parts, done = texts[row], [], 0
                    for s, e in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
                        parts.append(text[done : block.start[a + s] - block.offset[d]])
                        done = block.start[a + e] - block.offset[d] if a + e < b else len(text)
                    texts[row] = b"".join([*parts, text[done:]])
            decoded = pa.array(texts, type=pa.binary()).cast(pa.string())
            out = [decoded if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep))

    return run


def remove_passages(documents: DataFrame, passages: DataFrame, min_left: int = 1) -> DataFrame:
    """The documents with their repeated passages cut out; ``n_chars`` follows the text.

    Texts without a passage stay as they are, byte for byte. A document of which fewer than
    ``min_left`` words are left goes. All other columns are kept. Spans go by doc_id alone, so
    rows that share one lose each other's spans too.
    """
    columns, name = documents.columns, free_name(documents, "_spans_")
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(name))
    joined = join_checked(documents, spans, ["doc_id"], "left").select(*columns, name)
    touched = joined.where(F.col(name).isNotNull()).mapInArrow(tidy(_cut(columns, name, min_left)), documents.schema)
    if "n_chars" in columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return joined.where(F.col(name).isNull()).select(columns).unionAll(touched.select(columns))
