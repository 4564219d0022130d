"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.support import crc_of_id

#: Labelled rows of each class that a classifier is fitted on, at most.
SAMPLE_PER_CLASS = 4000


def training_rows(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` rows of each class outside the held-out fold.

    Rows are chosen by a hash of their id, so the sample does not depend on partitioning. Null
    ids and labels are left out; of an id's repeated labels the highest counts, and of its
    repeated documents the least text, so the bound holds for rows too. The chosen ids
    are few by the bound above, so they are broadcast, and only their texts are shuffled.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_of_id(F.col("doc_id")) % modulus != held_out))
    one_each = usable.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = [one_each.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    found = documents.select("doc_id", "text").join(F.broadcast(reduce(DataFrame.unionAll, chosen)), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def centred_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin at which a cut makes the fewest errors, midway between its neighbours.

    Equal margins are not parted; if either side will do, all fall below the cut.
    """
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    between = np.concatenate([[True], m[1:] > m[:-1], [True]])
    places = np.flatnonzero(between & (errors == errors[between].min()))
    k = int(places[len(places) // 2])
    if k == 0 or k == len(m):
        return float(m[0] - 1 if k == 0 else m[-1] + 1)
    return float((m[k - 1] + m[k]) / 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
