"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.components import connected_components
from timeloom.llm.support import cut, join_checked, written
from timeloom.llm.textkernel import as_signed, blocks, mix, shingles
from timeloom.llm.workers import tidy

#: Documents and n-grams of a block of a family, about; pairs of blocks are verified together.
BLOCK_DOCS = 512
BLOCK_GRAMS = 1 << 20


@dataclass(frozen=True)
class Banding:
    """``bands`` bands of ``rows`` MinHash values each."""

    bands: int
    rows: int

    @staticmethod
    def for_recall(similarity: float, recall: float, max_hashes: int = 144) -> Banding:
        """The most selective banding of at most ``max_hashes`` values that finds a pair of the
        given similarity with at least the given probability."""
        best = None
        for rows in range(1, 33):
            bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
            if bands * rows <= max_hashes:
                best = Banding(bands, rows)
        if best is None:
            raise ValueError("no banding reaches this recall within max_hashes")
        return best


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    return base[:n] | np.uint64(1), base[n:]


def _signatures(width: int, banding: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, flips = _constants(banding.bands * banding.rows, 1)
        weight = _constants(banding.rows, 2)[0]
        for batch in batches:
            for block in blocks(batch.column("text")):
                grams, first = shingles(block, width)
                n, full = len(block), np.flatnonzero(np.diff(first) > 0)
                size, keys = np.zeros(n, np.int32), np.zeros((n, 2), np.uint64)
                for d in full.tolist():
                    own = np.unique(grams[first[d] : first[d + 1]])
                    size[d], keys[d] = len(own), (own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                bands = np.zeros((len(full), banding.bands), np.uint64)
                for b in range(banding.bands):
                    for r in range(banding.rows):
                        k = b * banding.rows + r
                        if len(full):
                            bands[:, b] += np.minimum.reduceat((grams ^ flips[k]) * times[k], first[full]) * weight[r]
                    bands[:, b] = mix(bands[:, b] + np.uint64(b + 1))
                offsets = np.zeros(n + 1, np.int32)
                offsets[1:] = np.cumsum((np.diff(first) > 0) * banding.bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.row0, n), pa.array(size), pa.array(as_signed(np.ascontiguousarray(keys[:, 0]))), pa.array(as_signed(np.ascontiguousarray(keys[:, 1]))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_signed(bands.ravel())))],
                    names=["doc_id", "n_grams", "key1", "key2", "bands"],
                )

    return run


def signatures(documents: DataFrame, width: int, banding: Banding) -> DataFrame:
    """Number and digest of each text's distinct n-grams, and its band hashes (none without words)."""
    return documents.select("doc_id", "text").mapInArrow(tidy(_signatures(width, banding)), "doc_id long, n_grams int, key1 long, key2 long, bands array<long>")


def _verified(width: int, similarity: float):
    """Reads rows sorted by (family, i, j) and verifies all pairs within a block or across two."""

    def links(key: tuple, ids: list, copies: list, sides: list, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        n = len(ids)
        size = np.array([len(s) for s in sets], dtype=np.float64)
        values, who = np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64))
        order = np.argsort(values, kind="stable")
        values, who = values[order], who[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        keep = shared[column]
        column, who = (np.cumsum(shared) - 1)[column[keep]], who[keep]
        common = np.zeros((n, n), dtype=np.float32)
        step = max(64, (1 << 22) // n)
        for begin in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(column, [begin, begin + step])
            part = np.zeros((n, min(step, int(column[b - 1]) - begin + 1)), dtype=np.float32)
            part[who[a:b], column[a:b] - begin] = 1
            common += part @ part.T
        linked = common * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-6
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:
            side = np.array(sides)
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        count = linked @ np.array(copies, dtype=np.float64)
        label = np.arange(n)
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(count > 0)
        ids = np.array(ids, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(count[some].astype(np.int64))], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, copies, sides, sets = None, [], [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            doc, copy, side = (batch.column(c).to_pylist() for c in ("doc_id", "copies", "block"))
            for block in blocks(batch.column("text")):
                grams, first = shingles(block, width)
                for d in range(len(block)):
                    row = block.row0 + d
                    if keys[row] != key:
                        if len(ids) > 1 and (found := links(key, ids, copies, sides, sets)) is not None:
                            yield found
                        key, ids, copies, sides, sets = keys[row], [], [], [], []
                    ids.append(doc[row])
                    copies.append(copy[row])
                    sides.append(side[row])
                    sets.append(np.unique(grams[first[d] : first[d + 1]]))
        if len(ids) > 1 and (found := links(key, ids, copies, sides, sets)) is not None:
            yield found

    return run


def jaccard_classes(documents: DataFrame, *, width: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each document, by Jaccard similarity of n-gram sets.

    Two documents are linked if their sets of ``width``-word n-grams have a Jaccard similarity
    of at least ``similarity``. ``n_links`` counts a document's partners, ``n_copies`` the
    documents with exactly its set (itself included), and ``class_id`` is the least doc_id that
    links lead to.

    1. Documents with equal sets collapse into one representative each (copies count as links
       by arithmetic, not by pairs).
    2. Representatives are shuffled on band hashes; in each bucket all point to its first
       document, so a bucket of n gives n - 1 edges. Components of these edges are families.
    3. The texts of families alone are shuffled. A large family is dealt into blocks by a hash,
       and each pair of blocks is verified on full sets in one task, with matrix products; only
       counts and a spanning forest leave the task. No pairs are emitted, none are skipped.
    4. Components of the verified edges are the classes.

    A text of fewer than ``width`` words has one n-gram of all its words. A null text, or one
    without words, has none and is a class of its own; so is a row with a null doc_id (its
    class_id is null). Rows that share a doc_id are one document: linked if any of them is.
    """
    banding = Banding.for_recall(similarity, recall)
    sigs = written(signatures(documents, width, banding))
    usable = sigs.where("n_grams > 0 and doc_id is not null")
    groups = usable.groupBy("n_grams", "key1", "key2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    placed = join_checked(sigs.select("doc_id", "n_grams", "key1", "key2"), groups, ["n_grams", "key1", "key2"], "left")
    placed = cut(placed.select("doc_id", "n_grams", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")))
    reps = placed.where("doc_id = rep and n_grams > 0").groupBy("doc_id").agg(F.max("n_grams").alias("n_grams"), F.max("copies").alias("copies"))

    banded = join_checked(usable.select("doc_id", "bands"), placed.where("doc_id <> rep").select("doc_id").distinct(), ["doc_id"], "left_anti")
    rows = banded.select("doc_id", F.explode("bands").alias("band"))
    bucket = Window.partitionBy("band").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    stars = rows.withColumn("lead", F.first("doc_id").over(bucket)).where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    families = cut(connected_components(stars).withColumnsRenamed({"node": "doc_id", "component": "family"}).join(reps, "doc_id"))

    sizes = families.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    dealt = join_checked(families, sizes.where("n_blocks > 1"), ["family"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    members = join_checked(documents.select("doc_id", "text"), dealt.select("doc_id", "family", "copies", "block", "n_blocks"), ["doc_id"], "inner")
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "copies", "block", "text"
    )
    ordered = pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id")
    verified = cut(ordered.mapInArrow(tidy(_verified(width, similarity)), "a long, b long, links long"))

    counts = verified.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = connected_components(verified).select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    linked = counts.join(classes, "rep", "left")
    out = join_checked(placed, linked, ["rep"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )


def keep_one_of_each(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents without those whose class has a smaller doc_id; columns stay as they are.

    Rows with a null doc_id stay. Of rows that share a doc_id and a class with others, all or
    none stay.
    """
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return join_checked(documents, gone, ["doc_id"], "left_anti").select(documents.columns)
