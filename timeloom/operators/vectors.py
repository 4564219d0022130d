"""Cosine search and near duplicates over float vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_bits(a: Column, bits: int = 64) -> Column:
    """A 64-bit code of the signs of the first entries (entry k is bit k)."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.when(F.get(a, k) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))))


def _unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a column of lists of one length, each over its own length; a zero vector stays zero."""
    n = len(column)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 0)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def cosine_top_k(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, k: int = 10, max_queries: int = 20_000, max_items: int = 65_536) -> DataFrame:
    """(query_id, item_id, score, rank): the k items nearest to each query, exactly.

    Up to ``max_queries`` counted query vectors go to every task, which multiplies each batch of
    items with all of them and keeps its own k best, so what is shuffled is k rows for each query and
    task. More queries are dealt into blocks by a hash of their id, and items into chunks
    of about ``max_items``; every block meets every chunk in a group of its own, so neither the driver nor
    a task holds more than one of each. Ties go to the lower id. Of rows of one query id an
    item counts with its best score for any of them.
    """
    usable = queries.select(F.col(query_id).cast("long").alias(query_id), F.col(vector).alias("v")).where("v is not null")
    pool = items.select(F.col(item_id).cast("long").alias(item_id), F.col(vector).alias("v")).where("v is not null")
    schema = f"{query_id} long, {item_id} long, score double"
    n = usable.count()
    if not n:
        return items.select(F.lit(None).cast("long").alias(query_id), F.col(item_id).cast("long").alias(item_id), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if n <= max_queries:
        found = pool.mapInArrow(_nearest_to(usable.toArrow(), item_id, query_id, k), schema)
    else:
        blocks, chunks = -(-n // max_queries), -(-pool.count() // max_items)
        q = usable.select(F.lit(True).alias("query"), F.col(query_id).alias("id"), "v", F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, chunks - 1)).cast("long"))).alias("chunk"))
        i = pool.select(F.lit(False).alias("query"), F.col(item_id).alias("id"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64(item_id), F.lit(max(1, chunks))).alias("chunk"))
        found = q.unionByName(i).groupBy("block", "chunk").applyInArrow(_block_nearest(item_id, query_id, k, max_queries), schema)
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), item_id)
    nearest = found.groupBy(query_id, item_id).agg(F.max("score").alias("score"))
    return nearest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(q: np.ndarray, found: tuple[np.ndarray, np.ndarray], ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of those found so far and of the rows of m, for each row of q."""
    best_s, best_i = found
    step = max(1, (1 << 22) // max(1, len(q)))
    for at in range(0, len(m), step):  # at most 32 MB of scores at a time
        s = np.round(q @ m[at : at + step].T, 9)
        s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(ids[at : at + step], s.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    return best_s, best_i


def _none(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((n, 0)), np.zeros((n, 0), np.int64)


def _nearest_to(rows: pa.Table, item_id: str, query_id: str, k: int):
    ids, q = rows.column(0).to_numpy(), _unit_rows(rows.column(1).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _none(len(ids))
        for batch in batches:
            found = _best(q, found, batch.column(0).to_numpy(), _unit_rows(batch.column(1)), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found[0].shape[1])), pa.array(found[1].ravel()), pa.array(found[0].ravel())], names=[query_id, item_id, "score"])

    return run


def _block_nearest(item_id: str, query_id: str, k: int, at_once: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(table.column("query"))
        rows = table.filter(pc.invert(table.column("query")))
        items, ids = _unit_rows(rows.column("v").combine_chunks()), rows.column("id").to_numpy()
        out = []
        for at in range(0, asked.num_rows, at_once):  # rows of one id share a block, however many they are
            some = asked.slice(at, at_once)
            s, i = _best(_unit_rows(some.column("v").combine_chunks()), _none(some.num_rows), ids, items, k)
            out.append((np.repeat(some.column("id").to_numpy(), s.shape[1]), i.ravel(), s.ravel()))
        q, i, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({query_id: q, item_id: i, "score": s})

    return run


#: Rows of a chunk of a block, rows that one pivot is taken for, pivots at most, and rows whose directions are looked at.
CHUNK, ROWS_A_PIVOT, PIVOTS, SAMPLE = 4096, 1024, 256, 1024

#: Shelves that chunks are put on, and the rows beyond which there are more of them (64 MB at 64 entries).
SHELVES, SHELF_ROWS = 16, 131_072


def near_vectors(items: DataFrame, item_id: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """(a, b, score) of pairs of vectors of one table with a cosine above the threshold, exactly.

    1. Every vector belongs to its nearest pivot, and a block's radius is the widest angle
       to its pivot. By the triangle inequality a vector has partners in a block only if its angle
       to that block's pivot is at most the radius plus that of the threshold. Blocks of
       more than ``CHUNK`` rows are dealt into chunks by a hash of their id.
    2. Chunks lie on ``SHELVES`` shelves, and two shelves meet in a group of their own, with the rows that
       may have partners on the other one. So a row is shuffled as often as there are shelves at most,
       however many chunks there are; only shelves of more than ``SHELF_ROWS`` rows make more of them.
    3. In a group two chunks meet, again with the rows alone that may have partners in the other. All
       vectors are turned so that the directions in which a sample varies most come first. The products
       of the first quarter of the entries, plus the most that the rest can add (the product of the rests'
       lengths), leave few pairs, and only of these the whole product is computed.

    Null and zero vectors have no partners, and rows of one id are not held against each other.
    Shorter vectors are filled up with zeros. Where no direction stands out, pivots rule out few blocks,
    and the first products of all pairs of chunks are computed: an exact join of such vectors has no
    index that spares them.
    """
    met = _meetings(items, item_id, vector, threshold)
    if met is None:
        return items.select(F.col(item_id).alias("a"), F.col(item_id).alias("b"), F.lit(0.0).alias("score")).limit(0)
    grouped, chunks, lead = met
    kind = items.schema[item_id].dataType.simpleString()
    return grouped.applyInArrow(_products(chunks, lead, threshold, False), f"a {kind}, b {kind}, score double")


def near_vector_work(items: DataFrame, item_id: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """(n_met, n_computed) of each group of :func:`near_vectors`: pairs of its chunks, and whole products."""
    met = _meetings(items, item_id, vector, threshold)
    if met is None:
        return items.select(F.lit(0).cast("long").alias("n_met"), F.lit(0).cast("long").alias("n_computed")).limit(0)
    grouped, chunks, lead = met
    return grouped.applyInArrow(_products(chunks, lead, threshold, True), "n_met long, n_computed long")


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _meetings(items: DataFrame, item_id: str, vector: str, threshold: float) -> tuple[GroupedData, tuple[Callable, Callable], int] | None:
    """The rows (g, chunk, i, u) by pair of shelves; the chunks that meet there and which vectors reach one; and the entries that are multiplied first."""
    rows = items.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(item_id).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    size, short, n = rows.select(F.max(F.size("v")), F.min(F.size("v")), F.count(F.lit(1))).first()
    if not n:
        return None
    if short < size:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))))
    sample = _unit_rows(rows.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks())
    turn = np.linalg.svd(sample, full_matrices=True)[2].T
    pivots = sample[: min(PIVOTS, -(-n // ROWS_A_PIVOT))] @ turn
    kind = items.schema[item_id].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_unit_rows(batch.column("v")) @ turn, pivots)
            yield pa.RecordBatch.from_arrays([pa.array(angles.argmin(axis=1).astype(np.int64)), pa.array(angles.min(axis=1, initial=np.pi))], names=["block", "angle"])

    radius, count = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in rows.mapInArrow(placed, "block long, angle double").groupBy("block").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r.block], count[r.block] = r.r, r.n
    chunks = -(-count // CHUNK)
    first, total, widest = np.cumsum(chunks) - chunks, int(chunks.sum()), float(np.arccos(threshold)) + 1e-7

    shelves = min(total, max(SHELVES, -(-n // SHELF_ROWS)))
    block_of = np.repeat(np.arange(len(chunks)), chunks)
    rows_of = count[block_of] / chunks[block_of]
    shelf_of = np.minimum((np.cumsum(rows_of) - rows_of / 2) * shelves // n, shelves - 1).astype(np.int64)
    held = np.zeros((len(chunks), shelves), np.int64)
    held[block_of, shelf_of] = 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _unit_rows(batch.column("v")) @ turn
            angles = _angles(u, pivots)
            block = angles.argmin(axis=1)
            own = first[block] + batch.column("h").to_numpy() % np.maximum(chunks[block], 1)
            shelf = shelf_of[own]
            row, other = np.nonzero((angles <= radius + widest) @ held)
            groups = np.minimum(shelf[row], other) * shelves + np.maximum(shelf[row], other)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(u)))]).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), u.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(groups)), pa.array(own), batch.column("i"), lists], names=["groups", "chunk", "i", "u"])

    def meeting(g: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of chunks of a pair of shelves, each once."""
        a, b = np.meshgrid(*(np.flatnonzero(shelf_of == k) for k in divmod(g, shelves)), indexing="ij")
        once = a <= b
        return a[once], b[once]

    def reach(u: np.ndarray, chunk: int) -> np.ndarray:
        p = block_of[chunk]
        return np.flatnonzero(_angles(u, pivots[p : p + 1])[:, 0] <= radius[p] + widest)

    keyed = rows.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(1 << 40)))
    spread = keyed.mapInArrow(dealt, f"groups array<long>, chunk long, i {kind}, u array<double>")
    return spread.select(F.explode("groups").alias("g"), "chunk", "i", "u").groupBy("g"), (meeting, reach), max(1, size // 4)


def _products(chunks: tuple[Callable, Callable], lead: int, threshold: float, count: bool):
    meeting, reach = chunks

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunk, ids = table.column("chunk").to_numpy(), table.column("i").combine_chunks()
        lists = table.column("u").combine_chunks()
        u = lists.flatten().to_numpy().reshape(len(lists), -1)
        front, rest = np.ascontiguousarray(u[:, :lead]), np.sqrt((u[:, lead:] ** 2).sum(axis=1))
        rows = {int(c): np.flatnonzero(chunk == c) for c in np.unique(chunk)}
        a, b, score, met, computed = [], [], [], 0, 0
        for p, q in zip(*(x.tolist() for x in meeting(table.column("g")[0].as_py())), strict=True):
            if p not in rows or q not in rows:
                continue
            left, right = (rows[p], rows[p]) if p == q else (rows[p][reach(u[rows[p]], q)], rows[q][reach(u[rows[q]], p)])
            met += len(left) * (len(left) - 1) // 2 if p == q else len(left) * len(right)
            for at in range(0, len(left), 1024):
                some = left[at : at + 1024]
                most = front[some] @ front[right].T
                most += rest[some, None] * rest[None, right]
                row, column = np.nonzero(most > threshold - 1e-9)
                x, y = some[row], right[column]
                if p == q:
                    x, y = x[x < y], y[x < y]
                computed += len(x)
                for k in range(0, len(x), 1 << 16):
                    i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    s = (u[i] * u[j]).sum(axis=1)
                    hit = s > threshold
                    a.append(i[hit])
                    b.append(j[hit])
                    score.append(s[hit])
        if count:
            return pa.table({"n_met": [met], "n_computed": [computed]})
        none = np.zeros(0, np.int64)
        x, y = (ids.take(pa.array(np.concatenate([none, *c]))) for c in (a, b))
        pairs = pa.table({"a": pc.if_else(pc.less(x, y), x, y), "b": pc.if_else(pc.less(x, y), y, x), "score": np.concatenate([np.zeros(0), *score])})
        return pairs.filter(pc.not_equal(x, y))

    return run
