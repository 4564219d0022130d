"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.labelled import SAMPLE_PER_CLASS, centred_threshold, sigmoid, training_rows
from timeloom.llm.support import crc_of_id, cut
from timeloom.llm.textkernel import BREAKS, Block, blocks
from timeloom.llm.workers import give_back, tidy

#: Buckets of the term hash, and lengths in bytes of the word beginnings that are terms too
#: (whole characters), which stand for stems: inflected and joined forms share them.
BUCKET_BITS = 20
PREFIX_BYTES = (4, 6, 7)
#: Sampled documents that have to hold a term; one in fewer cannot be told from chance.
MIN_SEEN = 4
#: Chi-square over which a term tells by itself (a chance of 0.001), and squared score over which
#: a pair does (a chance of some 1e-12, as there are up to 8 million pairs).
ALONE, TOGETHER = 10.8, 50.0
#: Terms whose pairs are held against each other, the most frequent ones, of those that so many
#: sampled documents hold at least one in.
PAIR_TERMS, PAIR_ONE_IN = 4096, 200
#: Settings of a fit, how weights shrink and steps; :func:`cross_validate` inside the training rows puts them first (README).
DECAY, ROUNDS = 5e-3, 80
#: Documents times terms up to which a fit holds them as a table (64 MB).
DENSE_CELLS = 1 << 24

MODULUS, HELD_OUT = 5, 0


def term_buckets(block: Block) -> np.ndarray:
    """Buckets of every word and of its beginnings: an array of shape (kinds, words)."""
    shift = np.uint64(64 - BUCKET_BITS)
    return np.stack([(h >> shift).astype(np.int32) for h in (block.hash, *(block.prefix_hash(n) for n in PREFIX_BYTES))])


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text"), BREAKS, fold_case=True):
            buckets = term_buckets(block)
            each = [np.unique(buckets[:, a:b]) for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(block.row0, len(block)), batch.column("y").slice(block.row0, len(block)), pa.array(each, type=pa.list_(pa.int32()))], names=["doc_id", "y", "terms"]
            )


@dataclass
class FactorizationMachine:
    """``place`` maps a bucket to its row of ``w`` and ``v``, or to -1."""

    place: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def margins(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
        """Margins of documents from (document, bucket) pairs; a repeated term counts once."""
        at = self.place[bucket]
        keep = at >= 0
        pairs = np.unique(doc[keep].astype(np.int64) * len(self.w) + at[keep])
        doc, at = pairs // len(self.w), pairs % len(self.w)
        linear = np.bincount(doc, weights=self.w[at], minlength=n_docs)
        cross = np.zeros(n_docs)
        for f in range(self.v.shape[1]):
            value = self.v[at, f]
            cross += np.bincount(doc, weights=value, minlength=n_docs) ** 2 - np.bincount(doc, weights=value * value, minlength=n_docs)
        return self.bias + linear + 0.5 * cross


def _telling(seen: np.ndarray, toxic: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The terms that tell the classes apart by themselves (chi-square over ``ALONE``).

    ``seen`` and ``toxic`` are the documents, and the toxic ones, that hold each term.
    """
    a, n = toxic.astype(np.float64), n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(n * (a * (n0 - seen + a) - (seen - a) * (n1 - a)) ** 2 / (float(n1 * n0) * seen * (n - seen)))
    return np.flatnonzero((chi > ALONE) & (seen >= MIN_SEEN))


def _frequent(seen: np.ndarray, n: int) -> np.ndarray:
    """The terms whose pairs are scored: the ``PAIR_TERMS`` most frequent of those that one document in ``PAIR_ONE_IN`` holds."""
    often = np.flatnonzero(seen >= max(MIN_SEEN, n / PAIR_ONE_IN))
    return np.sort(often[np.argsort(-seen[often], kind="stable")][:PAIR_TERMS])


def _telling_pairs(terms: list[np.ndarray], residual: np.ndarray, spread: np.ndarray, block: int = 256) -> np.ndarray:
    """The terms of pairs whose presence together tells what the model so far leaves open.

    A pair's score is the square of its documents' summed residuals over their variance. All
    pairs of :func:`_frequent` terms are scored, as products of blocks of columns.
    """
    flat, doc = np.concatenate(terms), np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    often = _frequent(np.bincount(flat, minlength=1 << BUCKET_BITS), len(terms))
    place = np.full(1 << BUCKET_BITS, -1, dtype=np.int16)
    place[often] = np.arange(len(often))
    at = place[flat]
    del flat
    doc, at = doc[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable").astype(np.int32)
    doc, at = doc[order], at[order]
    del order

    def columns(k: int) -> np.ndarray:
        inside = slice(*np.searchsorted(at, [k, k + block]))
        x = np.zeros((len(terms), min(block, len(often) - k)), dtype=np.float32)
        x[doc[inside], at[inside] - k] = 1
        return x

    told = np.zeros(len(often), dtype=bool)
    r, s = residual.astype(np.float32)[:, None], spread.astype(np.float32)[:, None]
    for i in range(0, len(often), block):
        left = columns(i)
        for j in range(i, len(often), block):
            right = left if i == j else columns(j)
            total, variance = (left * r).T @ right, (left * s).T @ right
            score = np.where(variance > 1, total**2 / np.maximum(variance, 1e-6), 0)
            if i == j:
                np.fill_diagonal(score, 0)
            hit = score > TOGETHER
            told[i : i + left.shape[1]] |= hit.any(axis=1)
            told[j : j + right.shape[1]] |= hit.any(axis=0)
    return often[told]


def _descend(terms: list[np.ndarray], y: np.ndarray, known: np.ndarray, *, factors: int = 6, rounds: int = ROUNDS, rate: float = 0.03, decay: float = DECAY, seed: int = 7) -> FactorizationMachine:
    """Weights and factors of the ``known`` terms by adaptive steps over all rows, classes weighing the same."""
    n1, n0 = y.sum(), (1 - y).sum()
    place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    place[known] = np.arange(len(known))
    rows = [place[t][place[t] >= 0] for t in terms]
    size = np.array([len(t) for t in rows])
    doc, at = np.repeat(np.arange(len(rows), dtype=np.int32), size), np.concatenate(rows)
    dense = len(rows) * len(known) <= DENSE_CELLS
    if dense:
        x = np.zeros((len(rows), max(1, len(known))), dtype=np.float32)
        x[doc, at] = 1
    else:
        full, by_term = np.flatnonzero(size), np.argsort(at, kind="stable")
        row_begin, term_begin, doc_by_term = (np.cumsum(size) - size)[full], np.searchsorted(at[by_term], np.arange(len(known))), doc[by_term]

    def by_row(values: np.ndarray) -> np.ndarray:
        """Sums of the terms' values over the terms of each document."""
        if dense:
            return x @ values
        out = np.zeros((len(rows), *values.shape[1:]), dtype=np.float32)
        out[full] = np.add.reduceat(values[at], row_begin, axis=0)
        return out

    def by_known(values: np.ndarray) -> np.ndarray:
        """Sums of the documents' values over the documents of each term."""
        return x.T @ values if dense else np.add.reduceat(values[doc_by_term], term_begin, axis=0)

    rng = np.random.default_rng(seed)
    w = np.zeros(max(1, len(known)), dtype=np.float32)
    v = rng.normal(0, 0.02, (len(w), factors)).astype(np.float32)
    bias, gains = np.float32(np.log(n1 / n0)), [np.full_like(w, 1e-6), np.full_like(v, 1e-6), np.float32(1e-6)]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    for _ in range(rounds if len(at) else 0):
        xv = by_row(v)
        m = bias + by_row(w) + 0.5 * ((xv**2).sum(1) - by_row((v**2).sum(1)))
        g = weight * (sigmoid(m) - y).astype(np.float32)
        each = by_known(g)
        grads = [each + decay * w, by_known(g[:, None] * xv) - v * each[:, None] + decay * v, g.sum()]
        moves = []
        for k, grad in enumerate(grads):
            gains[k] = 0.95 * gains[k] + 0.05 * grad**2
            moves.append(rate * grad / np.sqrt(gains[k] + 1e-12))
        w, v, bias = w - moves[0], v - moves[1], bias - moves[2]
    return FactorizationMachine(place, w.astype(np.float64), v.astype(np.float64), float(bias))


def _known(terms: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms that tell the classes apart, alone or in pairs.

    A machine is fitted to the terms that tell by themselves, with hardly any decay, so it leaves
    open no more than it must. All pairs of frequent terms are held against that.
    """
    n1, n0 = int(y.sum()), int((1 - y).sum())
    toxic = np.bincount(np.concatenate([t for t, c in zip(terms, y, strict=True) if c]), minlength=1 << BUCKET_BITS)
    alone = _telling(np.bincount(np.concatenate(terms), minlength=1 << BUCKET_BITS), toxic, n1, n0)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    p = sigmoid(_all_margins(_descend(terms, y, alone, rounds=80, decay=2e-4), terms))
    return np.union1d(alone, _telling_pairs(terms, weight * (y - p), weight**2 * p * (1 - p)))


def _all_margins(model: FactorizationMachine, terms: list[np.ndarray]) -> np.ndarray:
    """Margins of documents by their terms, a thousand at a time."""
    out = [np.zeros(0)]
    for k in range(0, len(terms), 1000):
        some = terms[k : k + 1000]
        out.append(model.margins(np.repeat(np.arange(len(some)), [len(t) for t in some]), np.concatenate(some), len(some)))
    return np.concatenate(out)


def fit(terms: list[np.ndarray], y: np.ndarray, decay: float = DECAY, rounds: int = ROUNDS) -> FactorizationMachine:
    """Fit on the terms that tell the classes apart, alone or in pairs (:func:`_known`).

    Other terms are left out: with some ten times as many terms as rows they would only be
    learnt by heart. Without rows of both classes there is nothing to learn, and
    no text is called toxic.
    """
    if not y.sum() or not (1 - y).sum():
        return FactorizationMachine(np.full(1 << BUCKET_BITS, -1, dtype=np.int32), np.zeros(1), np.zeros((1, 1)), -1.0)
    model = _descend(terms, y, _known(terms, y), decay=decay, rounds=rounds)
    model.bias -= centred_threshold(_all_margins(model, terms), y)
    return model


def cross_validate(terms: list[np.ndarray], y: np.ndarray, settings: list[tuple[float, int]], folds: int = 4) -> dict[tuple[float, int], tuple[float, float]]:
    """(accuracy, share of toxic rows found) of each (decay, rounds), on rows that the fit has not seen.

    Row k is in fold k modulo ``folds``; everything, the choice of terms too, is done anew without
    a fold before it is judged by it. Only training rows may go in.
    """
    fold, right = np.arange(len(y)) % folds, {s: np.zeros(len(y), dtype=bool) for s in settings}
    for f in range(folds):
        seen = [t for t, k in zip(terms, fold, strict=True) if k != f]
        rest = [t for t, k in zip(terms, fold, strict=True) if k == f]
        known = _known(seen, y[fold != f])
        for decay, rounds in settings:
            model = _descend(seen, y[fold != f], known, decay=decay, rounds=rounds)
            cut_at = centred_threshold(_all_margins(model, seen), y[fold != f])
            right[decay, rounds][fold == f] = (_all_margins(model, rest) > cut_at) == (y[fold == f] == 1)
    return {s: (float(r.mean()), float(r[y == 1].mean())) for s, r in right.items()}


def fit_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> FactorizationMachine:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    model = fit(*training_terms(documents, labels, per_class))
    give_back()  # the sample's memory, which the driver may need for what follows
    return model


def training_terms(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and classes of at most ``per_class`` labelled rows of each class outside the held-out fold.

    Only texts are inputs. Terms are counted on the executors. The counts tell which terms tell
    by themselves or are frequent, and of each sampled document the executors send these alone:
    at most 2 * ``per_class`` lists of as a rule some hundred numbers.
    """
    rows = cut(training_rows(documents, labels, "toxic", MODULUS, HELD_OUT, per_class).mapInArrow(tidy(_terms_of), "doc_id long, y int, terms array<int>"))
    n1, n0 = rows.select(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a")).where(F.col("n") >= MIN_SEEN).toArrow()
    seen, toxic = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    at = counts.column("term").to_numpy()
    seen[at], toxic[at] = counts.column("n").to_numpy(), counts.column("a").to_numpy()
    wanted = np.zeros(1 << BUCKET_BITS, dtype=bool)
    wanted[_telling(seen, toxic, n1, n0)] = True
    wanted[_frequent(seen, n1 + n0)] = True
    got = rows.mapInArrow(tidy(_only(wanted)), "doc_id long, y int, terms array<int>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    terms = got.column("terms").combine_chunks() if got.num_rows else pa.array([], type=pa.list_(pa.int32()))
    return [np.asarray(t.values) for t in terms], got.column("y").to_numpy().astype(np.float64)


def _only(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            flat = lists.flatten().to_numpy()
            keep = known[flat]
            ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), kept], names=["doc_id", "y", "terms"])

    return run


def _scored(model: FactorizationMachine, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BREAKS, fold_case=True):
                buckets = term_buckets(block)
                doc = np.tile(np.repeat(np.arange(len(block)), block.counts()), len(buckets))
                score = sigmoid(model.margins(doc, buckets.ravel(), len(block)))
                rest = batch.slice(block.row0, len(block))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score)], names=[*batch.schema.names, name])

    return run


def score_toxicity(documents: DataFrame, model: FactorizationMachine, name: str = "score") -> DataFrame:
    """The documents with a column ``name`` (0 to 1), from whole texts; all columns are kept.

    Null and empty texts, and texts without a known term, get the bias's score, which is below
    one half. A column that is called ``name`` already is replaced.
    """
    rows = documents.drop(name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType(), False)])
    return rows.mapInArrow(tidy(_scored(model, name)), schema)


def classify_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold, score and decision of each document; rows are as many as the documents."""
    model = fit_toxicity(documents, labels)
    scored = score_toxicity(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(crc_of_id(F.col("doc_id")) % MODULUS == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
