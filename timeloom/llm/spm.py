"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from timeloom.llm.idpool import IdPool
from timeloom.llm.support import bounded_batches
from timeloom.llm.textkernel import Block, blocks, hash_ranges
from timeloom.llm.workers import kept, tidy

#: The character that stands for a space inside pieces.
META = "▁"
#: Distinct units whose ids a worker keeps.
CACHE_UNITS = 500_000
#: Characters after which the search looks for a boundary to commit.
COMMIT_EVERY = 256
#: What an unknown character scores below the least piece, and its decoded form.
UNKNOWN_PENALTY, UNKNOWN_SURFACE = 10.0, " ⁇ "
#: Model types of the file format.
UNIGRAM, MERGES = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message; groups do not occur."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, message[at : at + size]
        at += size


class Vocabulary:
    """Pieces and scores of a model that leaves texts as they are but for a space put first.

    ``by_merges`` tells models made by merges, whose scores are ranks of merges, from unigram
    models, whose scores are added up. Models of other kinds, or that normalise texts, are an
    error.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {number: value for number, value in _fields(model.serialized_model_proto()) if number in (2, 3)}
        kind, normalizer = dict(_fields(spec.get(2, b""))).get(3, UNIGRAM), dict(_fields(spec.get(3, b"")))
        if kind not in (UNIGRAM, MERGES):
            raise ValueError(f"models of type {kind} are not supported")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("models that normalise texts are not supported")
        self.by_merges = kind == MERGES
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: model.get_score(i) for i in normal}
        self.unknown_score = min(self.score.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        if any(META in p.lstrip(META) for p in self.ids):
            raise ValueError("pieces that go on beyond a space are not supported")
        #: Endings of pieces, which bound the search backwards from an end.
        self.endings = {p[k:] for p in self.ids for k in range(len(p))}
        #: Whether two bytes stand side by side in some piece. Where they don't, all paths meet.
        self.joined = np.zeros((256, 256), dtype=bool)
        for p in self.ids:
            b = np.frombuffer(p.replace(META, " ").encode(), dtype=np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # never within a character
        surface = dict.fromkeys(range(n), b"") | {i: self.pieces[i].replace(META, " ").encode() for i in normal} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        surface[self.unknown] = UNKNOWN_SURFACE.encode()
        self.out_size = np.array([len(surface[i]) for i in range(n)], dtype=np.int64)
        self.out_begin = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(surface[i] for i in range(n)), dtype=np.uint8)
        self._fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short string by merges alone, best score first, then leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether merges leave the two pieces as they are when they stand side by side."""
        key = (a, b)
        if key not in self._fits:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = self.merge(a + b) == [a, b]
        return self._fits[key]


class StreamingViterbi:
    """The best path of pieces, searched from left to right in a window of bounded length.

    Each end keeps one backpointer, the last piece of the best path to it. Only ends within the
    longest piece of the newest one can be gone on from; whenever the paths from all of these
    meet in one boundary, the pieces before it are committed and forgotten. ``widest`` is the
    greatest number of backpointers held so far.

    * ``add_scores``: the best path has the greatest sum of scores; of equal sums the one whose
      last piece is longest. A character that is no piece is unknown and scores less than all.
    * Else (models made by merges): a path is valid if every two neighbours on it stay apart
      when merged together. Each prefix has just one valid path, so it is the best one, and it
      is the one that merging the whole text gives. A character that is no piece stands alone.
    """

    def __init__(self, vocabulary: Vocabulary, add_scores: bool | None = None):
        self.v = vocabulary
        self.add_scores = not vocabulary.by_merges if add_scores is None else add_scores
        self.widest = 0

    def _valid(self, text: str, begin: int, end: int, last: dict[int, str]) -> None:
        """One more end, by merges: the first piece that fits is the last of the only valid path."""
        ids, fits, endings = self.v.ids, self.v.fits, self.v.endings
        for at in range(end - 1, begin - 1, -1):
            piece = text[at:end]
            if piece in ids or end - at == 1:
                before = last.get(at)
                if at == 0 or (before is not None and fits(before, piece)):
                    last[end] = piece
                    return
            if piece not in endings:
                return

    def _best(self, text: str, begin: int, end: int, last: dict[int, str], sums: dict[int, float]) -> None:
        """One more end, by sums of scores."""
        score, endings = self.v.score, self.v.endings
        best, chosen = -np.inf, ""
        for at in range(end - 1, begin - 1, -1):
            piece = text[at:end]
            own = score.get(piece, self.v.unknown_score if end - at == 1 else None)
            if own is not None and at in sums and sums[at] + own >= best:
                best, chosen = sums[at] + own, piece
            if piece not in endings:
                break
        last[end], sums[end] = chosen, best

    def pieces(self, text: str) -> Iterator[str]:
        longest = self.v.longest
        last: dict[int, str] = {}  # end -> last piece of the best path to it
        sums = {0: 0.0}
        done = 0
        for end in range(1, len(text) + 1):
            begin = max(done, end - longest)
            if self.add_scores:
                self._best(text, begin, end, last, sums)
            else:
                self._valid(text, begin, end, last)
            if end % COMMIT_EVERY == 0:
                self.widest = max(self.widest, len(last))
                heads = {e for e in range(max(done, end - longest) + 1, end + 1) if e in last}
                while len(heads) > 1:
                    far = max(heads)
                    heads.remove(far)
                    heads.add(far - len(last[far]))
                meet = heads.pop()
                if meet > done:
                    yield from self._path(last, done, meet)
                    last = {e: p for e, p in last.items() if e > meet}
                    # Sums count from the boundary, so they stay exact however long the text is.
                    sums = {e: s - sums[meet] for e, s in sums.items() if e >= meet} if self.add_scores else sums
                    done = meet
        yield from self._path(last, done, len(text))

    @staticmethod
    def _path(last: dict[int, str], begin: int, end: int) -> list[str]:
        path = []
        while end > begin:
            path.append(last[end])
            end -= len(last[end])
        return path[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            known = self.v.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.v.byte_ids:
                out += [self.v.byte_ids[b] for b in piece.encode()]
            elif not out or out[-1] != self.v.unknown:  # unknown characters in a row are one
                out.append(self.v.unknown)
        return out


class Encoder:
    """Whole texts by units, cut wherever no piece holds the two bytes side by side.

    At such places all paths meet (a space after a word, many a mark). Distinct units are
    searched once and their ids kept; a unit's bytes are compared with those that its hash
    found. A text with the pieces' own space character in it, or with a unit that only shares
    its hash, is searched in one go.
    """

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.search = StreamingViterbi(self.v)
        self.pool = IdPool(np.int32, CACHE_UNITS)

    def _ids(self, unit: bytes, first: bool) -> list[int]:
        text = unit.decode().replace(" ", META)
        return self.search.encode(META + text if first else text)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a block's documents, the number of each, and the documents to search in one go."""
        data, offset = block.data, block.offset
        lead = offset[:-1][offset[:-1] < offset[1:]]
        if not len(lead):
            return np.zeros(0, np.int32), np.zeros(len(block), np.int64), np.zeros(0, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.v.joined[data[:-1], data[1:]]
        # The space that encoding puts first belongs to the first unit, if pieces hold the two.
        cut[lead] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        head = np.zeros(len(data), bool)
        head[lead] = True
        head = head[begin]
        edge = np.searchsorted(begin, offset)

        def learn(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = data.tobytes()
            found = [self._ids(raw[a:b], h) for a, b, h in zip(begin[rows].tolist(), end[rows].tolist(), head[rows].tolist(), strict=True)]
            return np.array([i for f in found for i in f], dtype=np.int32), np.array([len(f) for f in found], dtype=np.int64)

        # Hashes are odd for units that begin a text and even for others.
        key = (hash_ranges(data, begin, end) & ~np.uint64(1)) | head.astype(np.uint64)
        flat, ends, wrong = self.pool.encode(data, begin, end, key, learn)
        odd = np.unique(np.searchsorted(edge, np.flatnonzero(wrong), side="right") - 1)
        return flat, np.diff(ends[edge]), odd

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, number of ids of each row) of stretches of a column."""
        mark = META.encode()
        for block in blocks(texts, block_bytes=1_000_000):
            flat, totals, odd = self.encode(block)
            raw, whole = block.data.tobytes(), set(odd.tolist())
            spans = list(zip(block.offset[:-1].tolist(), block.offset[1:].tolist(), strict=True))
            if mark in raw:
                whole.update(d for d, (a, b) in enumerate(spans) if mark in raw[a:b])
            if whole or not self.v.byte_ids:
                parts = np.split(flat, np.cumsum(totals)[:-1])
                for d in whole:
                    parts[d] = np.array(self._ids(raw[slice(*spans[d])], True), np.int32)
                if not self.v.byte_ids:  # unknown characters on both sides of a cut are one
                    parts = [p[np.concatenate([[True], (p[1:] != self.v.unknown) | (p[:-1] != self.v.unknown)])] if len(p) else p for p in parts]
                flat, totals = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            yield block.row0, flat, totals


def _encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def _vocabulary(path: str) -> Vocabulary:
    return kept(("vocabulary", path), lambda: Vocabulary(path))


def decode_ids(v: Vocabulary, flat: np.ndarray, totals: np.ndarray) -> list[bytes]:
    """The bytes of each id list; the space that encoding puts first is dropped."""
    size = v.out_size[flat]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = v.out_bytes[np.repeat(v.out_begin[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    edges = ends[np.concatenate([[0], np.cumsum(totals)])].tolist()
    out = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [o[1:] if o[:1] == b" " else o for o in out]


def _lists(flat: np.ndarray, totals: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(totals)]).astype(np.int32)), pa.array(flat, type=pa.int32()))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, flat, totals in _encoder(path).encode_column(batch.column("text")):
                rest = batch.slice(row, len(totals))
                yield pa.RecordBatch.from_arrays([*rest.columns, _lists(flat, totals), pa.array(totals)], names=[*batch.schema.names, "ids", "n_tokens"])

    return run


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """The rows with ``ids`` (the model's piece ids of the whole text) and ``n_tokens``.

    All columns are kept; those called ``ids`` or ``n_tokens`` are replaced. Null and empty
    texts have no ids.
    """
    rows = bounded_batches(documents).drop("ids", "n_tokens")
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.LongType(), False)])
    return rows.mapInArrow(tidy(_encode(model_path), ("encoder", model_path)), schema)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path)
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            texts = decode_ids(v, lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode("utf-8", "replace") for t in texts], type=pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``; null and empty lists give no text."""
    rows = bounded_batches(encoded).drop("decoded")
    return rows.mapInArrow(tidy(_decode(model_path), ("vocabulary", model_path)), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType(), False)]))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for row, flat, totals in _encoder(path).encode_column(batch.column("text")):
                n, ends = len(totals), np.cumsum(totals)
                raw = flat.astype("<u4")
                crcs = [zlib.crc32(raw[e - k : e]) for e, k in zip(ends.tolist(), totals.tolist(), strict=True)]
                back = decode_ids(_encoder(path).v, flat, totals)
                same = [a == b for a, b in zip(back, texts[row : row + n], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), pa.array(totals), pa.array(crcs, type=pa.int64()), pa.array([zlib.crc32(b) for b in back], type=pa.int64()), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"],
                )

    return run


def encoding_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip) of each document.

    Checksums are unsigned crc32 of the ids as little-endian 32-bit integers and of the decoded
    text; ``round_trip`` tells whether the latter is the text itself, which holds unless the
    text has the pieces' space character in it.
    """
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(tidy(_digests(model_path), ("encoder", model_path)), "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
