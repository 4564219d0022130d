"""Quality scores from histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.labelled import SAMPLE_PER_CLASS, centred_threshold, sigmoid, training_rows
from timeloom.llm.support import crc_of_id
from timeloom.llm.textkernel import Block, blocks, hash_ranges, shingles

MODULUS, HELD_OUT = 3, 1

#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "wide": range(128, 256),
    "newline": (10,),
    "stop": (46, 63),
    "comma": (44, 59, 58),
    "bang": (33,),
    "pipe": (124,),
    "hash": (35, 42, 36, 37, 38),
    "bracket": (40, 41, 60, 62, 91, 93, 123, 125),
    "quote": (34, 39, 96),
    "slash": (47, 92, 61, 64, 95, 43, 45, 126, 94),
}
STATISTICS = [*CLASSES, "log_words", "mean_word", "sd_word", "distinct_words", "repeat_next", "repeat_windows", "one_byte_words", "long_words", "words_per_line", "repeat_lines"]

_CLASS = np.full(256, len(CLASSES), dtype=np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k


def _duplicates(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, how many of its keys repeat an earlier one of it."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][same], minlength=n_docs)


def statistics_of(block: Block) -> np.ndarray:
    """A row of statistics for each document; zeros for one without words."""
    n = len(block)
    words = block.counts()
    doc_of_word = np.repeat(np.arange(n), words)
    size = (block.end - block.start).astype(np.float64)
    n_bytes = np.diff(block.offset)
    doc_of_byte = np.repeat(np.arange(n), n_bytes)
    width = len(CLASSES) + 1
    shares = np.bincount(doc_of_byte * width + _CLASS[block.data], minlength=n * width).reshape(n, width)[:, :-1]
    w, b = np.maximum(words, 1), np.maximum(n_bytes, 1)
    mean = np.bincount(doc_of_word, weights=size, minlength=n) / w
    square = np.bincount(doc_of_word, weights=size**2, minlength=n) / w
    repeated = block.hash[1:] == block.hash[:-1]
    repeated &= doc_of_word[1:] == doc_of_word[:-1]
    windows, first = shingles(block)
    doc_of_window = np.repeat(np.arange(n), np.diff(first))
    lines = np.flatnonzero(block.data == 10)
    edges = np.unique(np.concatenate([block.offset[:-1], lines + 1, block.offset[1:]]))
    edges = edges[edges <= len(block.data)]
    line_hash = hash_ranges(block.data, edges[:-1], edges[1:]) if len(edges) > 1 else np.zeros(0, np.uint64)
    doc_of_line = np.searchsorted(block.offset, edges[:-1], side="right") - 1 if len(edges) > 1 else np.zeros(0, np.int64)
    n_lines = np.maximum(np.bincount(doc_of_line, minlength=n), 1)
    columns = [
        *(shares / b[:, None]).T,
        np.log1p(words),
        mean,
        np.sqrt(np.maximum(square - mean**2, 0)),
        1 - _duplicates(block.hash, doc_of_word, n) / w,
        np.bincount(doc_of_word[1:][repeated], minlength=n) / w,
        _duplicates(windows, doc_of_window, n) / np.maximum(np.diff(first), 1),
        np.bincount(doc_of_word, weights=size == 1, minlength=n) / w,
        np.bincount(doc_of_word, weights=size > 14, minlength=n) / w,
        words / n_lines,
        _duplicates(line_hash, doc_of_line, n) / n_lines,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Trees:
    """Complete binary trees of one depth, level by level in flat arrays."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, one level at a time."""
        n_trees, rows = len(self.feature), np.arange(len(x))[:, None]
        tree = np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Logistic boosting: split gains come from histograms of gradients over binned statistics."""
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return Trees(depth, feature, cut, leaf, 1.0 if n1 else -1.0)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * bins
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    margin = np.zeros(len(y))
    for t in range(trees):
        p = sigmoid(margin)
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            begin, width = 2**level - 1, 2**level
            key = ((node - begin)[:, None] * (d * bins) + flat).ravel()
            size = width * d * bins
            hist = [np.bincount(key, weights=np.repeat(v, d), minlength=size).reshape(width, d, bins).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = hist
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < 2.0) | (all_h - left_h < 2.0)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, at in enumerate(best.tolist()):
                j, bin_ = divmod(at, bins)
                if gain[k, j, bin_] > 1e-9 and bin_ < len(edges[j]):
                    feature[t, begin + k], cut[t, begin + k] = j, edges[j][bin_]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + ridge)
        margin += leaf[t, at]
    return Trees(depth, feature, cut, leaf, -centred_threshold(margin, y))


def _with(columns: list[str], add):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rest = batch.slice(block.row0, len(block))
                yield pa.RecordBatch.from_arrays([*rest.columns, *add(statistics_of(block))], names=[*batch.schema.names, *columns])

    return run


def document_statistics(rows: DataFrame) -> DataFrame:
    """The rows with an array ``stats`` of each text's statistics, in the order of ``STATISTICS``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType(), False), False)])
    return rows.mapInArrow(_with(["stats"], lambda s: [pa.array(list(s), type=pa.list_(pa.float64()))]), schema)


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Trees:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    rows = document_statistics(training_rows(documents, labels, "quality", MODULUS, HELD_OUT, per_class)).drop("text")
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    if not got.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = got.column("stats").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return fit(x, got.column("y").to_numpy().astype(np.float64))


def score_quality(documents: DataFrame, model: Trees) -> DataFrame:
    """The documents with ``score`` (0 to 1, higher is better), from whole texts.

    All columns are kept; one called ``score`` is replaced. Null and empty texts have
    statistics of zero and are scored as such.
    """
    rows = documents.drop("score")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType(), False)])
    return rows.mapInArrow(_with(["score"], lambda s: [pa.array(sigmoid(model.margins(s)))]), schema)


def classify_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold, score and decision of each document; rows are as many as the documents."""
    scored = score_quality(documents.select("doc_id", "text"), fit_quality(documents, labels))
    return scored.select(
        "doc_id",
        F.coalesce(crc_of_id(F.col("doc_id")) % MODULUS == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
