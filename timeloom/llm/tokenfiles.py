"""Token ids in Parquet list columns, with controlled row groups and page indexes."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.idpool import IdPool
from timeloom.llm.support import bounded_batches, clean_text, shared_dir
from timeloom.llm.textkernel import Block, blocks, string_buffers

FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType(), False),
    T.StructField("local_start", T.LongType(), False),
    T.StructField("n_tokens", T.IntegerType(), False),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
])


class WordEncoder:
    """Ids of whole texts, by words cut at ASCII white space.

    The vocabulary is caseless, drops white space, and no piece spans white space or the edge
    between a letter and a following mark, so the ids of a text are those of its words in turn.
    Each distinct word is encoded once and its ids stay in a pool, found by the word's 64-bit
    hash. The bytes of every word are compared with those that its hash found; a text with a word
    that only shares its hash, or with the text of an added token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps(spec.get("normalizer") or {}) + json.dumps(spec.get("pre_tokenizer") or {})
        suffix = spec["model"].get("end_of_word_suffix")
        self.added = [t["content"].lower().encode() for t in spec.get("added_tokens") or []]
        self.by_word = bool(suffix) and "Lowercase" in steps and '"Removed"' in steps
        if self.by_word:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.closes = np.array([(self.plain.id_to_token(i) or "").endswith(suffix) for i in range(self.plain.get_vocab_size())])
        self.pool = IdPool(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), 2048) for e in self.tokenizer.encode_batch_fast(texts[k : k + 2048], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words (ASCII words in lower case), and the number of each.

        A word of lower-case letters alone passes the normaliser unchanged and is one piece
        before merges, so such words are encoded many at a time; ids that close a word part
        them again.
        """
        size, begin, used, flats = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0, []
        letters, odd = [], []
        for i, w in enumerate(words):
            if w.isalpha():  # ASCII letters
                letters.append((i, w))
            elif not w.isascii() and (t := w.decode().lower()).isalpha() and max(t) < "\u0250" and unicodedata.is_normalized("NFC", t):
                letters.append((i, t.encode()))
            else:
                odd.append(i)
        for k in range(0, len(letters), 512):
            at, some = zip(*letters[k : k + 512], strict=True)
            flat = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.pool.dtype)
            ends = np.flatnonzero(self.closes[flat]) + 1
            if len(ends) != len(at):
                odd += at
                continue
            at = list(at)
            size[at] = np.diff(ends, prepend=0)
            begin[at] = used + ends - size[at]
            flats.append(flat)
            used += len(flat)
        for i, ids in zip(odd, self._ids([words[i].decode() for i in odd]), strict=True):
            size[i], begin[i] = len(ids), used
            flats.append(np.array(ids, self.pool.dtype))
            used += len(ids)
        ends = np.cumsum(size)
        return np.concatenate(flats)[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])], size

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a block's documents in one array, the number of each document, and the
        documents with a word whose bytes are not those that its hash found."""

        def learn(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = block.folded.tobytes()
            return self._learn([raw[s:e] for s, e in zip(block.start[rows].tolist(), block.end[rows].tolist(), strict=True)])

        flat, ends, wrong = self.pool.encode(block.folded, block.start, block.end, block.hash, learn)
        odd = np.unique(np.searchsorted(block.first, np.flatnonzero(wrong), side="right") - 1)
        return flat.astype(np.int32, copy=False), np.diff(ends[block.first]), odd

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, number of ids of each row) of stretches of a column.

        A tokenizer of another kind, whose pieces may span words, encodes whole texts.
        """
        if not self.by_word:
            data, offset = string_buffers(texts)
            raw = data.tobytes()
            for row in range(len(texts)):
                ids = np.array(self._ids([raw[offset[row] : offset[row + 1]].decode()])[0], np.int32)
                yield row, ids, np.array([len(ids)], np.int64)
            return
        for block in blocks(texts, fold_case=True, split_marks=True, block_bytes=600_000, fold_ascii_words=True):
            flat, totals, odd = self.encode(block)
            folded, whole = block.data.tobytes().lower() if self.added else b"", set(odd.tolist())
            if any(t in folded for t in self.added):
                texts_of = (folded[a:b] for a, b in zip(block.offset[:-1], block.offset[1:], strict=True))
                whole.update(d for d, text in enumerate(texts_of) if any(t in text for t in self.added))
            if whole:
                parts = np.split(flat, np.cumsum(totals)[:-1])
                for d in whole:
                    parts[d] = np.array(self._ids([block.data[block.offset[d] : block.offset[d + 1]].tobytes().decode()])[0], np.int32)
                flat, totals = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            yield block.row0, flat, totals


_ENCODERS: dict[str, WordEncoder] = {}


def _encoded(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, flat, totals in _ENCODERS[path].encode_column(batch.column(1)):
                n = len(totals)
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(totals), end_id).astype(np.int32, copy=False)
                    totals = totals + 1
                ends = np.cumsum(totals)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.full(n, part, np.int32)), pa.array(start + ends - totals), pa.array(totals.astype(np.int32)), lists],
                    names=[f.name for f in FILE_SCHEMA],
                )
                start += int(ends[-1])

    return run


def write_token_files(documents: DataFrame, tokenizer_path: str, out: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20) -> None:
    """Encode every text and write ids to Parquet in ascending order of ids.

    Files follow each other by name and hold disjoint ranges of ids. Next to the list column,
    which is dictionary-encoded, stand the metadata: ``part`` (the file), ``local_start`` (ids
    before the document in its file) and ``n_tokens``; page indexes let a reader take either
    alone or a range of documents. A null text is empty and gives the end id alone; a null id
    sorts first; equal ids stand together, in the order of their texts.
    """
    rows = bounded_batches(documents, "3m").select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        placed.mapInArrow(_encoded(tokenizer_path, end_id), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.dictionary.page.size", str(page_bytes))
        .parquet(out)
    )


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' documents with their global ``start``; only the named columns are read.

    The table of file totals has a row for each file, which bounds what is broadcast.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    rows = files.join(F.broadcast(base), "part").withColumn("start", F.col("_base") + F.col("local_start"))
    return rows.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        crcs = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(crcs, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """Count and unsigned crc32 (ids as little-endian 32-bit integers) of each document's ids."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_round_trip(documents: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the token files to the shared folder and return their digests as read back."""
    spark = documents.sparkSession
    out = shared_dir(spark)
    write_token_files(documents, tokenizer_path, out, end_id=end_id)
    return token_digests(read_token_files(spark, out, ["doc_id", "start", "ids"]))
