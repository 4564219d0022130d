"""Whitening of vectors by a tall and skinny QR: no covariance is formed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.intvectors import matrix, whole_vectors
from timeloom.llm.support import written

#: Components that are kept, and the factor before entries are floored.
COMPONENTS, SCALE = 4, 256
#: Floored entries beyond this are an error: sums of fewer than 2**22 of them stay whole numbers within a long.
LARGEST = 1 << 40
#: Factors that one task merges at a time, and rows that go into one QR.
FAN, ROWS = 8, 4096


@dataclass
class Whitening:
    """``components`` are rows, unit vectors by falling ``eigenvalues``; those beyond the rank have the eigenvalue 0."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums as whole numbers, and x less the mean, rounded once."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if most < 1 << 62 else object
        moved = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return moved, moved.astype(np.float64) / self.n


def _sums(length: int):
    """A task's number of vectors and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * length
        for batch in batches:
            x = matrix(batch.column("x"), length)
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], type=pa.list_(pa.string()))], names=["n", "sums"])

    return run


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _packed(node: int, r: np.ndarray) -> dict[str, list]:
    return {"node": [node], "r": [np.ascontiguousarray(r).tobytes()]}


def _factored(model: Whitening, length: int):
    """A task's R factor, from its centred rows, a block at a time below the factor so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, length))
        for batch in batches:
            x = matrix(batch.column("x"), length)
            for at in range(0, len(x), ROWS):
                r = _factor(np.concatenate([r, model.centred(x[at : at + ROWS])[1]]))
        if len(r):
            yield pa.RecordBatch.from_pydict(_packed(TaskContext.get().partitionId(), r), schema=_FACTOR)

    return run


_FACTOR = pa.schema([("node", pa.int64()), ("r", pa.binary())])


def _merged(length: int):
    def run(table: pa.Table) -> pa.Table:
        r = np.zeros((0, length))
        for node in sorted(range(len(table)), key=table.column("node").to_pylist().__getitem__):
            r = _factor(np.concatenate([r, np.frombuffer(table.column("r")[node].as_py()).reshape(-1, length)]))
        return pa.Table.from_pydict(_packed(table.column("node")[0].as_py() // FAN, r), schema=_FACTOR)

    return run


def tall_factor(vectors: DataFrame, model: Whitening, length: int) -> np.ndarray:
    """R of the QR of all centred vectors.

    Every partition gives the R of its own rows, and ``FAN`` of these at a time are merged, as often as
    it takes until one is left, so no task holds more than a few squares of the vectors' length.
    The driver gets that one square.
    """
    tasks = vectors.rdd.getNumPartitions()
    rs = written(vectors.select("x").mapInArrow(_factored(model, length), "node long, r binary"))
    while tasks > 1:
        rs = rs.withColumn("of", F.floor(F.col("node") / FAN)).groupBy("of").applyInArrow(_merged(length), "node long, r binary")
        tasks = -(-tasks // FAN)
    last = rs.toArrow().column("r")
    return np.frombuffer(last[0].as_py()).reshape(-1, length) if len(last) else np.zeros((0, length))


def fit_whitening(vectors: DataFrame, length: int, n_components: int = COMPONENTS) -> Whitening:
    """Mean and principal components of a table of whole-number vectors ``x``, each row counting once.

    Rows are centred by exact sums. The right singular vectors of R are the covariance's eigenvectors,
    and its squared singular values over n the eigenvalues, without squaring what they were made
    of. A component's greatest entry is positive, so its sign does not depend on the rows' order.
    """
    parts = vectors.select("x").mapInArrow(_sums(length), "n long, sums array<string>")
    each = parts.select("n", F.posexplode_outer("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    n, sums = (int(each[0].n) if each else 0), [int(r.s) for r in each if r.s is not None]
    model = Whitening(n, sums, np.zeros((0, length)), np.zeros(0), 0.0)
    if not n or not length:
        return model
    r = tall_factor(vectors, model, length)
    _, singular, right = np.linalg.svd(r)
    singular = np.concatenate([singular, np.zeros(length - len(singular))])
    singular[singular <= singular[0] * max(n, length) * np.finfo(float).eps] = 0
    model.trace = float((singular**2).sum() / n)
    right = right[:n_components]
    sign = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])
    model.components, model.eigenvalues = right * sign[:, None], singular[: len(right)] ** 2 / n
    return model


def _whitened(model: Whitening, keep: list[str], length: int):
    from_value = np.divide(1.0, np.sqrt(model.eigenvalues), out=np.full(len(model.eigenvalues), np.nan), where=model.eigenvalues > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved, centred = model.centred(matrix(batch.column("x"), length))
            if moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * max(1, length) >= 1 << 63:
                moved = moved.astype(object)
            deviation = [int(d) if d < 1 << 63 else None for d in (moved * moved).sum(axis=1).tolist()]
            values = (centred @ model.components.T) * from_value
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), from_pandas=True), values.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(deviation, type=pa.int64()), lists], names=[*keep, "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, model: Whitening, keep: list[str], length: int) -> DataFrame:
    """(``keep``, deviation, whitened) of rows with a whole-number vector ``x``.

    ``deviation`` is the exact sum over dimensions of (n * x - sums)**2, null where that is
    beyond a long. ``whitened`` has an entry for each component: the centred vector
    projected on it, over the root of its eigenvalue; null where that is 0.
    """
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.select(*keep, "x").mapInArrow(_whitened(model, keep, length), schema)


def identity_error(vectors: DataFrame, model: Whitening, length: int) -> float:
    """The largest absolute entry of the covariance of the whitened ``vectors`` minus the identity.

    Components of the eigenvalue 0 are left out. Covariances are Spark's, which centre as they go."""
    used = [k for k, e in enumerate(model.eigenvalues) if e > 0]
    if not used:
        return 0.0
    wide = whiten(vectors, model, [], length).select(*(F.get("whitened", F.lit(k)).alias(f"w{k}") for k in used))
    pairs = [(a, b) for a in used for b in used if a <= b]
    found = wide.agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, found, strict=True))


def whitened_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", n_components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Rows whose vector is null or holds null or non-finite entries are left out. The fit takes each
    distinct floored vector once, so no group of copies weighs more than one; copies still get
    rows of their own, as do null and repeated ids. A table without usable vectors gives no rows.
    Components beyond the rank of the fit are explained by 0 and whitened to null. Shorter
    vectors of a table of mixed lengths are filled up with zeros.
    """
    rows, length = whole_vectors(table.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v")), ["vec_id"], "v", SCALE, LARGEST)
    distinct = written(rows.select("x").distinct())
    model = fit_whitening(distinct, length, n_components)
    error = identity_error(distinct, model, length)
    explained = model.eigenvalues / model.trace if model.trace else model.eigenvalues
    each = whiten(rows, model, ["vec_id"], length).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(e)) for e in explained)) if len(explained) else F.array().cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
