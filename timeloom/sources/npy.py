"""Vectors in ``.npy`` files as a data source: every task reads a range of rows by its offset."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a task, unless the option ``rows`` says otherwise, and rows of a batch.
ROWS, BATCH = 65_536, 4096


@dataclass
class RowRange(InputPartition):
    path: str
    offset: int
    first: int
    rows: int
    width: int
    dtype: str


def _open(path: str):
    """A file of any file system that Arrow knows by its address; a path without one is local."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _files(path: str) -> list[str]:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(".npy"))


def _header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and begin of the data. A file without rows or columns in C order has no ranges of rows."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        if len(shape) != 2 or fortran or dtype.hasobject:
            raise ValueError(f"{path} holds no table of numbers by rows: {shape}, {dtype}")
        return shape, dtype, f.tell()


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[RowRange]:
        out = []
        for path in _files(self.path):
            (n, width), dtype, offset = _header(path)
            out += [RowRange(path, offset + k * width * dtype.itemsize, k, min(self.rows, n - k), width, dtype.str) for k in range(0, n, self.rows)]
        return out or [RowRange("", 0, 0, 0, 0, "<f4")]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        system, inner = _open(part.path)
        with system.open_input_file(inner) as f:
            f.seek(part.offset)
            for k in range(0, part.rows, BATCH):
                n = min(BATCH, part.rows - k)
                values = np.frombuffer(f.read(n * part.width * np.dtype(part.dtype).itemsize), dtype=part.dtype).astype(np.float32)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * part.width)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(n) + part.first + k), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["path", "row", "vector"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: (path, row, vector) of a file, or of all in a folder."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, row long, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", ROWS)))


def read_npy(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(path, row, vector) of the vectors of a file or folder, ``rows`` of them to a task.

    Numbers of any type become floats. The driver reads the files' headers only. A folder without
    files gives no rows; a file that is no table of numbers by rows is an error.
    """
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rows", rows).load(path)


def write_npy(vectors: DataFrame, column: str, path: str) -> DataFrame:
    """Write every partition's vectors, all of one length, to a file of its own; returns (path, n) of the files when run.

    A task that runs again writes the same file anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(b), -1) for b in batches if len(b)]
        if parts:
            name = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.npy"
            system, inner = _open(name)
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            with system.open_output_stream(inner) as f:
                np.lib.format.write_array(f, np.concatenate(parts), allow_pickle=False)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(map(len, parts))])], names=["path", "n"])

    return vectors.select(column).where(f"{column} IS NOT NULL").mapInArrow(run, "path string, n long")
