"""WARC archives of web pages, and their records as tables of chunks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.support import bounded_batches, join_checked, shared_dir, written

#: Payload bytes of an archive, about; of a record segment at most; and of a chunk at most.
ARCHIVE_BYTES = 32 << 20
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
#: Neighbouring segments of a record that stay in one archive.
SEGMENTS_TOGETHER = 4
#: Fixed value: a gzip member of no bytes, which stands between the members of records.
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Payloads below this are never revisits.
MIN_REVISIT_BYTES = 100

_URN = "urn:timeloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column, row: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.left(digest, F.lit(16)), F.lit(":"), row.cast("string"), F.lit(">"))


def _header(kind: Column, fields: dict[str, Column]) -> Column:
    """A record's head; a field that is null is left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n"))) for k, v in fields.items()]
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("\r\n"))


def classified(pages: DataFrame) -> tuple[DataFrame, int]:
    """The pages with payload, digest, record_type, refers_to and the row it refers to; and all payload bytes.

    Digests are gathered in a narrow table first. Only payloads that occur more than once are
    joined back (broadcast if they are few enough). ``row`` numbers the rows of the scan, so
    the table has to be one that reads the same twice, as files do.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    narrow = written(rows.select("page_id", "row", "payload_bytes", "payload_digest"))
    total = narrow.agg(F.sum("payload_bytes")).first()[0] or 0
    big = narrow.where((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = big.groupBy("payload_digest").agg(F.min(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    joined = join_checked(rows, first, ["payload_digest"], "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first.page_id"), F.lit(False))
    kinds = {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first.page_id")), "refers_to_row": F.when(revisit, F.col("first.row"))}
    return joined.withColumns(kinds).drop("first"), total


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member of its own, so that it can be read from its offset."""
    for batch in batches:
        for head, body in zip(batch.column("head"), batch.column("body"), strict=True):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            parts = [pack.compress(head.as_buffer()), pack.compress(body.as_buffer()), pack.compress(b"\r\n\r\n"), pack.flush()]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], type=pa.binary())], names=["value"])


def write_archives(pages: DataFrame, out: str, *, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """Write a record for each page; archives hold about ``archive_bytes`` of payload each.

    Of pages with equal payloads of at least ``MIN_REVISIT_BYTES``, that with the least page_id
    is a response and the others revisit it; all other pages are responses. Rows that repeat
    the least page_id are responses too, and so are pages with a null id; every record has an id
    of its own. A payload of more than ``segment_bytes`` is cut, segment by segment, into a
    response and continuations. These are dealt out like records, a few neighbours at a time, so
    a long payload runs through several archives of the series and no archive grows with one.
    Null html is an empty payload; a null url is left out, and white space or control characters
    in one are percent-encoded blanks. ``compression`` is "gzip" (a member for each record) or "none".
    """
    rows, total = classified(pages)
    response = F.col("record_type") == "response"
    count = F.when(response, F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / segment_bytes))).otherwise(F.lit(1)).cast("int")
    kept = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    # One number is exploded for each segment, and the segment is then cut from the payload: they are never all held at once.
    numbered = rows.withColumn("count", count).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    segments = numbered.select("page_id", "row", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_row", "count", "k", F.substring(kept, F.col("k") * segment_bytes + 1, F.lit(segment_bytes)).alias("body"))
    placed = segments.repartition(max(1, -(-total // archive_bytes)), F.xxhash64("row", F.floor(F.col("k") / SEGMENTS_TOGETHER))).sortWithinPartitions("row", "k")
    k, one = F.col("k"), F.col("count") == 1
    base = _record_id(F.col("page_id"), F.col("payload_digest"), F.col("row"))
    first = k == 0
    head = _header(
        F.when(first, F.col("record_type")).otherwise("continuation"),
        {
            "WARC-Record-ID": F.when(first, base).otherwise(F.concat(F.left(base, F.length(base) - 1), F.lit(":"), k + 1, F.lit(">"))),
            "WARC-Date": F.lit("1970-01-01T00:00:00Z"),
            "WARC-Target-URI": F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"),
            "WARC-Refers-To": F.when(F.col("refers_to").isNotNull(), _record_id(F.col("refers_to"), F.col("payload_digest"), F.col("refers_to_row"))),
            "WARC-Profile": F.when(F.col("refers_to").isNotNull(), F.lit(_PROFILE)),
            "WARC-Payload-Digest": F.concat(F.lit("sha256:"), "payload_digest"),
            "WARC-Segment-Number": F.when(~one, k + 1),
            "WARC-Segment-Origin-ID": F.when(~first, base),
            "WARC-Segment-Total-Length": F.when(~one & (k == F.col("count") - 1), F.col("payload_bytes")),
            "X-Payload-Length": F.col("payload_bytes"),
            "X-Page-ID": F.col("page_id"),
            "X-Refers-To-Page-ID": F.col("refers_to"),
            "Content-Type": F.when(response, F.lit("text/html")),
            "Content-Length": F.octet_length("body"),
        },
    )
    if compression == "gzip":
        packed = bounded_batches(placed.select(head.cast("binary").alias("head"), "body")).mapInArrow(_members, "value binary")
        packed.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).text(out)
    else:
        placed.select(F.concat(head.cast("binary"), "body").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(out)


class _Stream:
    """Bytes of an archive, unpacked a block at a time."""

    def __init__(self, content: bytes | memoryview, block: int = CHUNK_BYTES):
        self.view, self.at, self.block = memoryview(content), 0, block
        self.unpack = zlib.decompressobj(31) if bytes(self.view[:2]) == b"\x1f\x8b" else None
        self.buffer = bytearray()

    def fill(self) -> bool:
        while True:
            if self.unpack is None:
                piece = bytes(self.view[self.at : self.at + self.block])
                self.at += len(piece)
                self.buffer += piece
                return bool(piece)
            if self.unpack.eof:
                rest = self.unpack.unused_data
                if not rest and self.at >= len(self.view):
                    return False
                self.unpack = zlib.decompressobj(31)
                source = rest or bytes(self.view[self.at : self.at + self.block])
                self.at += 0 if rest else len(source)
            else:
                source = self.unpack.unconsumed_tail
                if not source:
                    source = bytes(self.view[self.at : self.at + self.block])
                    self.at += len(source)
                    if not source:
                        return False
            piece = self.unpack.decompress(source, self.block)
            if piece:
                self.buffer += piece
                return True

    def head(self) -> dict[str, str] | None:
        """Fields of the next record; None at the end."""
        begin = 0
        while (end := self.buffer.find(b"\r\n\r\n", begin)) < 0:
            begin = max(0, len(self.buffer) - 3)
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("archive ends within a record's head")
                return None
        lines = bytes(self.buffer[:end]).decode().split("\r\n")
        del self.buffer[: end + 4]
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        return dict(x.split(": ", 1) for x in lines[1:])

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of at most a block."""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("archive ends within a payload")
            piece = bytes(self.buffer[: min(n, self.block)])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def _checked(head: dict[str, str], size: int, digest: str) -> None:
    if (size, "sha256:" + digest) != (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"]):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")


def record_chunks(content: bytes | memoryview, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(head, chunk number, chunk, bytes so far, digest so far, is last) of each record of an archive.

    Of a record no more than a chunk is in memory; the digest is carried from chunk to chunk. A
    payload that does not have the length and digest that its head names is an error. Chunks of
    a record of several segments are numbered and digested within the segment, as the others
    may be in other archives; ``is last`` is then the segment's.
    """
    stream = _Stream(content, chunk_bytes)
    while (head := stream.head()) is not None:
        left, number, size, digest = int(head["Content-Length"]), 0, 0, hashlib.sha256()
        for piece in stream.take(left):
            digest.update(piece)
            size += len(piece)
            yield head, number, piece, size, digest.hexdigest(), size == left
            number += 1
        if number == 0:
            yield head, 0, b"", 0, digest.hexdigest(), True
        if head["WARC-Type"] == "response" and "WARC-Segment-Number" not in head:
            _checked(head, size, digest.hexdigest())
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("record does not end where it should")


_CHUNKS = "record_id string, page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, chunk_no int, chunk_bytes int, bytes_so_far long, digest_so_far string, is_last boolean"
_NAMES = [x.split()[0] for x in _CHUNKS.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]


def _packed(rows: list[tuple], more: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [*_TYPES, *more.values()], strict=True)], names=[*_NAMES, *more])


def _batched(rows: Iterator[tuple], more: dict[str, pa.DataType], at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``at_once`` rows, or of a few chunks' bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[len(_NAMES)] or b"")
        if len(held) >= at_once or size > 8 * CHUNK_BYTES:
            yield _packed(held, more)
            held, size = [], 0
    if held:
        yield _packed(held, more)


def _chunk_rows(with_data: bool):
    def rows_of(content: memoryview) -> Iterator[tuple]:
        for head, k, piece, size, digest, last in record_chunks(content):
            number = int(head.get("WARC-Segment-Number", 0))
            page, refers = (int(head[n]) if n in head else None for n in ("X-Page-ID", "X-Refers-To-Page-ID"))
            origin = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"])[1:-1]
            yield (
                origin, page, "response" if number else head["WARC-Type"], refers, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"),
                k, len(piece), size, digest, last, piece if with_data or number else None, number,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batched(rows_of(memoryview(content.as_buffer())), {"data": pa.binary(), "segment": pa.int32()}, 2000)

    return run


def _carried(with_data: bool):
    """Reads segments' chunks sorted by record, segment and chunk; numbers and digests them as one payload."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        record, number, size, digest, segment = None, 0, 0, hashlib.sha256(), 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*_NAMES, "data", "segment")), strict=True):
                if row[0] != record:
                    record, number, size, digest, segment = row[0], 0, 0, hashlib.sha256(), 0
                if row[13] not in (segment, segment + 1):
                    raise ValueError(f"a segment of {record} is missing")
                segment = row[13]
                digest.update(row[12])
                size += len(row[12])
                last = size == row[5]
                if last:
                    _checked({"WARC-Record-ID": record, "X-Payload-Length": row[5], "WARC-Payload-Digest": f"sha256:{row[6]}"}, size, digest.hexdigest())
                yield (*row[:7], number, len(row[12]), size, digest.hexdigest(), last, row[12] if with_data else None)
                number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows_of(batches), {"data": pa.binary()}, 2000)

    return run


def read_archives(spark: SparkSession, path: str, *, with_data: bool = True) -> DataFrame:
    """The archives' records as a table of chunks, a row for each record and chunk number.

    ``bytes_so_far`` and ``digest_so_far`` are carried along a record; in the row that
    ``is_last`` they are the whole payload's (of a response). ``data`` is the chunk itself.
    Archives are read whole, so each must be of a size that a worker can hold (those of
    :func:`write_archives` are). Records of several segments are put in order by a sort of
    their chunks, and streamed through one digest each.
    """
    files = bounded_batches(spark.read.format("binaryFile").load(path).select("content"))
    chunks = written(files.mapInArrow(_chunk_rows(with_data), _CHUNKS + ", data binary, segment int"))
    columns = [*_NAMES, "data"] if with_data else _NAMES
    parts = bounded_batches(chunks.where("segment > 0").repartition("record_id").sortWithinPartitions("record_id", "segment", "chunk_no"))
    whole = parts.mapInArrow(_carried(with_data), _CHUNKS + ", data binary")
    return chunks.where("segment = 0").select(columns).unionAll(whole.select(columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and return each record as read back."""
    spark = pages.sparkSession
    out = shared_dir(spark)
    write_archives(pages, out)
    last = read_archives(spark, out, with_data=False).where("is_last")
    response = F.col("record_type") == "response"
    return last.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
