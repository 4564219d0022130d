"""Float vectors as vectors of whole numbers, on which sums and distances are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.support import written


def whole_vectors(table: DataFrame, keep: list[str], vector: str, scale: int, largest: int, parts: int = 1) -> tuple[DataFrame, int]:
    """(``keep``, x) with x = floor(``scale`` * component) of every usable row, and the length of x.

    Rows whose vector is null, or holds a null or non-finite component, are left out. Shorter
    vectors of a table of mixed lengths end in zeros, and so do all if their length is no multiple
    of ``parts``. A component whose floor lies beyond ``largest`` is an error, as results would not
    fit their types. The table is written to the shared folder, since all that follows reads it
    again and again.
    """
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = table.where(F.col(vector).isNotNull() & ~odd)
    rows = written(usable.select(*keep, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")))
    size, short, low, high = rows.select(F.max(F.size("x")), F.min(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low is not None and (low < -largest or high > largest):
        raise ValueError(f"components of {vector!r} times {scale} go from {low} to {high}, beyond {largest}")
    length = -(-(size or 0) // parts) * parts
    if size is not None and short < length:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("x"))))
    return rows, length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The rows of a column of lists of ``length`` whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)
