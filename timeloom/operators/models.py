"""Model calls as injected providers, outside of plans that may run twice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    """A chat client: prompts in, (content, reasoning) pairs out."""

    def complete(self, model: str, prompts: list[str], max_tokens: int, temperature: float) -> list[tuple[str | None, str | None]]: ...


class FakeProvider:
    """Deterministic replies for tests: a hash of model and prompt, cut to the token limit."""

    def complete(self, model: str, prompts: list[str], max_tokens: int, temperature: float) -> list[tuple[str | None, str | None]]:
        return [(hashlib.sha256(f"{model}\n{p}".encode()).hexdigest()[: 4 * max_tokens], None) for p in prompts]


def chat(calls: DataFrame, make: Callable[[], Provider], *, prompt: str = "prompt", model: str = "model", max_tokens: int = 400, temperature: float = 0.3) -> DataFrame:
    """The calls with ``reply``: the content, or the reasoning where the content is blank.

    A provider is made once in each task. Write the result before it is used twice: Spark may
    run a task again, and each run calls the model.
    """
    schema = T.StructType([*calls.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            replies = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for name, rows in batch.groupby(model, sort=False):
                got = provider.complete(str(name), rows[prompt].tolist(), max_tokens, temperature)
                replies[rows.index] = [c if c and c.strip() else r for c, r in got]
            yield batch.assign(reply=replies)

    return calls.mapInPandas(run, schema)


def cached_chat(calls: DataFrame, cache: DataFrame, make: Callable[[], Provider], **options) -> tuple[DataFrame, DataFrame]:
    """(replies to all calls, new rows of the cache); the cache is keyed by a hash of model and prompt."""
    keyed = calls.withColumn("input_key", F.sha2(F.concat_ws("\n", "model", "prompt"), 256))
    new = chat(keyed.select("input_key", "model", "prompt").dropDuplicates(["input_key"]).join(cache, "input_key", "left_anti"), make, **options).select("input_key", "reply")
    return keyed.join(cache.select("input_key", "reply").unionByName(new), "input_key", "left"), new


def first_reply(attempts: list[Column], min_chars: int = 30) -> Column:
    """Fallback chain: the first attempt that has at least ``min_chars`` characters but for white space."""
    from timeloom.functions.scalars import strip

    return F.coalesce(*(F.when(F.length(strip(a)) >= min_chars, a) for a in attempts))


def write_in_turn(sections: DataFrame, make: Callable[[], Provider], *, key: str = "video_id", order: str = "section_pos", prompt: str = "prompt", tail: int = 2000, max_tokens: int = 400) -> DataFrame:
    """(key, order, md): each section's text is made in view of the end of those before it.

    Calls follow each other within a key and run in parallel across keys.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        provider, written, out = make(), "", []
        for row in pdf.sort_values(order).itertuples(index=False):
            got = provider.complete("writer", [f"{getattr(row, prompt)}\n{written[-tail:]}"], max_tokens, 0.3)[0]
            text = got[0] or got[1] or ""
            written = f"{written}\n{text}" if written else text
            out.append((getattr(row, key), getattr(row, order), text))
        return pd.DataFrame(out, columns=[key, order, "md"])

    t = dict(sections.dtypes)
    return sections.groupBy(key).applyInPandas(run, f"{key} {t[key]}, {order} {t[order]}, md string")


class Embedder(Protocol):
    """A vector model: texts (or images as bytes) in, rows of floats out."""

    def embed(self, inputs: list) -> np.ndarray: ...


class FakeEmbedder:
    """Deterministic vectors for tests: the first bytes of a hash of the input, as parts of 255."""

    def __init__(self, size: int = 8):
        self.size = size

    def embed(self, inputs: list) -> np.ndarray:
        digests = [hashlib.sha256(x if isinstance(x, bytes) else str(x).encode()).digest() for x in inputs]
        return np.array([list(d[: self.size]) for d in digests], dtype=np.float64).reshape(len(inputs), self.size) / 255


def embed(rows: DataFrame, make: Callable[[], Embedder], column: str, name: str = "embedding") -> DataFrame:
    """The rows with the vector of a column (text or binary); null has none.

    A model is made once in each task and gets a batch at a time. Write the result before it
    is used twice.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            some = batch[column].notna().to_numpy()
            vectors = iter(model.embed(batch[column][some].tolist()).tolist() if some.any() else [])
            yield batch.assign(**{name: [next(vectors) if s else None for s in some]})

    return rows.mapInPandas(run, schema)


def perceptual_hash(grey: np.ndarray) -> int:
    """A 64-bit hash of a grey picture, as a signed long, bit k being entry k in reading order.

    The picture is averaged down to 32 by 32, and of its cosine transform the 8 by 8 lowest
    frequencies are held against their median.
    """
    rows, columns = (np.linspace(0, n, 33).astype(int) for n in grey.shape)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    (a, b), (c, d) = ((x[:-1], np.maximum(x[1:], x[:-1] + 1)) for x in (rows, columns))
    small = (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / ((b - a)[:, None] * (d - c)[None, :])
    k = np.arange(32)
    cosines = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)[:8]
    low = (cosines @ small @ cosines.T).ravel()
    bits = low > np.median(low)
    return int(np.array([sum(1 << i for i in np.flatnonzero(bits).tolist())], dtype=np.uint64).view(np.int64)[0])


def hash_pictures(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], content: str = "content", name: str = "phash_bits") -> DataFrame:
    """The files (of a ``binaryFile`` scan) with the perceptual hash of each; null where nothing can be decoded.

    ``decode`` turns a file's bytes into a grey picture.
    """
    schema = T.StructType([*(f for f in files.schema.fields if f.name != content), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pictures = [decode(b) if b is not None else None for b in batch[content]]
            yield batch.drop(columns=content).assign(**{name: pd.array([perceptual_hash(p) if p is not None and p.size else None for p in pictures], dtype="Int64")})

    return files.mapInPandas(run, schema)


def probe(models: DataFrame, make: Callable[[], Provider], *, model: str = "model", prompt: str = "ping") -> DataFrame:
    """(model, ok, error): whether each model replies at all; an error is its first line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            rows = []
            for name in batch[model]:
                try:
                    reply = provider.complete(name, [prompt], 16, 0.0)[0]
                    rows.append((name, bool(reply[0] or reply[1]), None if reply[0] or reply[1] else "no reply"))
                except Exception as e:  # a probe reports whatever goes wrong
                    rows.append((name, False, str(e).split("\n")[0]))
            yield pd.DataFrame(rows, columns=["model", "ok", "error"])

    return models.select(model).mapInPandas(run, "model string, ok boolean, error string")
