"""Short codes for vectors: each part of one is named by the nearest entry of its codebook.

Codebooks come from Lloyd's rounds over all rows. A round computes only the distances that
Elkan's bounds leave open: every row carries, for each of its parts, an upper bound on the
distance to its entry and a lower bound on that to each other entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.intvectors import matrix, whole_vectors
from timeloom.llm.support import discard, join_checked, shared_dir, written

#: Parts of a vector, entries of a codebook, rounds, and the factor before components are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Floored components beyond this would take the squared distance of 64 of them out of a long.
LARGEST = 1 << 27
#: Rows of a table of distances.
ROWS = 4096
#: Factors that move a computed root, or a bound, safely up or down.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Lower bounds are stored in 16 bits: the factor and the term that make up for their rounding,
#: and the highest of them.
HALF_DOWN, HALF_LEAST, HALF_MOST = 1 - 2.0**-10, 2.0**-23, 65000.0


@dataclass
class Codebooks:
    """``entries`` has the shape (parts, entries, width); ``moved`` is how far each came in the last round."""

    entries: np.ndarray
    moved: np.ndarray
    #: What one step of a stored lower bound stands for, a power of two.
    unit: float
    #: Type in which squared distances are exact.
    exact: type

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.entries.shape


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to the same row of c, exactly."""
    apart = x - c
    return (apart * apart).sum(axis=1)


def _all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exactly: sums of whole numbers within the type's range."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


class PartSearch:
    """The nearest entries of one part's codebook; of equally near ones the first."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray, exact: type):
        self.c, self.moved, self.exact = entries.astype(exact), moved, exact
        between = np.sqrt(_all_squared(self.c, self.c).astype(np.float64)) * (0.5 * DOWN)
        np.fill_diagonal(between, np.inf)
        #: Half the distances between entries, and half of each entry's to the one next to it.
        self.half, self.next = between, between.min(axis=1, initial=np.inf)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper, lower, distances computed) of rows without bounds."""
        d = _all_squared(x, self.c)
        entry = d.argmin(axis=1)
        root = np.sqrt(d.astype(np.float64))
        return entry, root[np.arange(len(x)), entry] * UP, root * DOWN, d.size

    def again(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the last round's bounds, shifted by what the entries have moved since.

        An entry is left out only if it is strictly farther than the present one, so equal
        distances are always computed, as whole numbers, and go to the lower index.
        """
        entry, upper = entry.copy(), (upper + self.moved[entry]) * UP
        lower = np.maximum((lower - self.moved) * DOWN, 0.0)
        live = np.flatnonzero(~(upper < self.next[entry]))
        if not len(live):
            return entry, upper, lower, 0
        own = entry[live]
        d = _squared(x[live], self.c[own])
        tight = np.sqrt(d.astype(np.float64))
        upper[live], lower[live, own], n = tight * UP, tight * DOWN, len(live)
        some = ~(upper[live] < self.next[own])
        live, own, d = live[some], own[some], d[some]
        most = upper[live][:, None]
        open_ = ~((lower[live] > most) | (self.half[own] > most))
        open_[np.arange(len(live)), own] = False
        row, other = np.nonzero(open_)
        table = np.full((len(live), len(self.c)), np.inf if self.exact is np.float64 else np.iinfo(np.int64).max, dtype=self.exact)
        table[np.arange(len(live)), own] = d
        for k in range(0, len(row), 1 << 18):
            part = slice(k, k + (1 << 18))
            table[row[part], other[part]] = _squared(x[live[row[part]]], self.c[other[part]])
        lower[live[row], other] = np.sqrt(table[row, other].astype(np.float64)) * DOWN
        best = table.argmin(axis=1)
        entry[live] = best
        upper[live] = np.sqrt(table[np.arange(len(live)), best].astype(np.float64)) * UP
        return entry, upper, lower, n + len(row)


_STATE = "x array<long>, entry array<int>, upper array<double>, lower binary, n_distances long"


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.array(values.ravel()[:0]).type))


def _searched(books: Codebooks, keep: list[str], last: bool):
    """Rows with their entries and bounds; of the last search the codes and errors instead."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [PartSearch(books.entries[p], books.moved[p], books.exact) for p in range(parts)]
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                n, x = len(batch), matrix(batch.column("x"), parts * width).astype(books.exact)
                again = "entry" in batch.schema.names
                if again:
                    old = matrix(batch.column("entry"), parts), batch.column("upper").flatten().to_numpy().reshape(n, parts)
                    bounds = np.frombuffer(b"".join(batch.column("lower").to_pylist()), dtype=np.float16).reshape(n, parts, k)
                entry, upper, error, done = np.zeros((n, parts), np.int32), np.zeros((n, parts)), np.zeros(n, np.int64), 0
                lower = np.zeros((n, parts, k), np.float16)
                for p, search in enumerate(searches):
                    own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    found = search.again(own, old[0][:, p], old[1][:, p], bounds[:, p].astype(np.float64) * books.unit) if again else search.first(own)
                    entry[:, p], upper[:, p] = found[:2]
                    done += found[3]
                    if last:
                        error += _squared(own, search.c[found[0]]).astype(np.int64)
                    else:
                        lower[:, p] = np.clip(found[2] / books.unit * HALF_DOWN - HALF_LEAST, 0, HALF_MOST)
                kept = [batch.column(c) for c in keep]
                if last:
                    digits = np.char.mod("%02x", entry)
                    code = digits[:, 0]
                    for p in range(1, parts):
                        code = np.char.add(code, digits[:, p])
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(code), pa.array(error)], names=[*keep, "code", "error"])
                else:
                    flat = lower.reshape(n, -1)
                    held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (2 * parts * k)).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                    each = np.zeros(n, np.int64)
                    each[:1] = done
                    yield pa.RecordBatch.from_arrays([*kept, batch.column("x"), _lists(entry), _lists(upper), held, pa.array(each)], names=[*keep, "x", "entry", "upper", "lower", "n_distances"])

    return run


def _partial_sums(parts: int, k: int, width: int):
    """Counts and sums of each entry's parts, a row for each that the task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for batch in batches:
            x, entry = matrix(batch.column("x"), parts * width), matrix(batch.column("entry"), parts)
            for p in range(parts):
                which = entry[:, p] + p * k
                count += np.bincount(which, minlength=parts * k)
                order = np.argsort(which, kind="stable")
                if width and len(order):
                    heads = np.flatnonzero(np.diff(which[order], prepend=-1))
                    total[which[order][heads]] += np.add.reduceat(x[order, p * width : (p + 1) * width], heads, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), type=pa.list_(pa.int64()))], names=["which", "n", "sums"])

    return run


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each used entry at the floor of its parts' mean. What the driver gets is one row for each entry and component."""
    parts, k, width = books.shape
    rows = state.select("x", "entry").mapInArrow(_partial_sums(parts, k, width), "which int, n long, sums array<long>")
    each = rows.select("which", "n", F.posexplode("sums").alias("at", "s")).groupBy("which", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toArrow()
    entries = books.entries.copy()
    flat = entries.reshape(parts * k, width)
    which, at = each.column("which").to_numpy(), each.column("at").to_numpy()
    flat[which, at] = [int(s) // n for s, n in zip(each.column("s").to_pylist(), each.column("n").to_pylist(), strict=True)]
    moved = np.sqrt(_squared(flat.astype(books.exact), books.entries.reshape(parts * k, width).astype(books.exact)).astype(np.float64)) * UP
    return Codebooks(entries, moved.reshape(parts, k), books.unit, books.exact)


def first_codebooks(rows: DataFrame, order: str, length: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of the parts of the ``entries`` rows of least ``order`` (nulls last; rows of one id by their vector)."""
    first = rows.orderBy(F.col(order).asc_nulls_last(), "x").limit(entries).select("x").toArrow().column("x")
    x = np.array([v.as_py() for v in first], dtype=np.int64).reshape(len(first), parts, length // parts).swapaxes(0, 1)
    low, high = rows.select(F.min(F.array_min("x")), F.max(F.array_max("x"))).first() if length else (0, 0)
    farthest = np.sqrt(float(max(1, length))) * float(max(1, (high or 0) - (low or 0)))
    unit = 2.0 ** max(-10, int(np.ceil(np.log2(farthest / HALF_MOST))))
    # Whole numbers below 2**53 are exact as doubles, in which products of matrices are fast.
    exact = np.float64 if length * (2.0 * max(abs(high or 0), abs(low or 0), 1)) ** 2 < 2.0**52 else np.int64
    return Codebooks(x, np.zeros(x.shape[:2]), unit, exact)


def learn_codebooks(rows: DataFrame, books: Codebooks, keep: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, list[int]]:
    """(state, codebooks, distances computed in each round) after ``rounds`` rounds over all rows.

    A round is one pass over the rows where they lie, which writes them with their new bounds to
    the shared folder, and one over their entries alone, which sums them up. No vector is
    shuffled. A round's table goes once its successor is there.
    """
    spark, state, path, counts = rows.sparkSession, rows, None, []
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    for _ in range(rounds):
        out = shared_dir(spark)
        state.mapInArrow(_searched(books, keep, False), f"{kept}, {_STATE}").write.parquet(out)
        if path:
            discard(spark, path)
        state, path = spark.read.parquet(out), out
        counts.append(state.select(F.sum("n_distances")).first()[0] or 0)
        books = _updated(state, books)
    return state, books, counts


def encode(state: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """(``keep``, code, error) of rows with or without bounds: the nearest entries, two hex digits each, and the squared distances to them summed up."""
    kept = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in keep)
    return state.drop("n_distances").mapInArrow(_searched(books, keep, True), f"{kept}, code string, error long")


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    Rows whose vector is null or holds null or non-finite components are left out; a table
    without others gives no rows. Repeated rows get a row each. With fewer rows than entries, the
    codebooks have as many entries as there are rows. Shorter vectors are filled up with zeros
    (:func:`whole_vectors`). ``label_error`` is the sum of the errors of the rows of a label,
    null being one.
    """
    source = table.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows, length = whole_vectors(source, ["vec_id", "label"], "v", SCALE, LARGEST, PARTS)
    books = first_codebooks(rows, "vec_id", length)
    if not books.shape[1]:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    keep = ["vec_id", "label"]
    state, books, _ = learn_codebooks(rows, books, keep, rounds)
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    null_safe = {"_null": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0).cast(source.schema["label"].dataType))}
    codes = written(encode(state, books, keep)).withColumns(null_safe)
    sums = codes.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"))
    return join_checked(codes, sums, ["_null", "_label"], "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
