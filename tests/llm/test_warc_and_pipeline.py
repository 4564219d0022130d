import hashlib

import pytest
from data import empty_documents, odd_documents

from timeloom.llm import queries, warc

ROWS = [
    (1, "u", "a" * 200), (2, "u 2\r\n", "a" * 200), (3, None, ""), (4, "x", None), (5, "x", "é\r\n\r\nz" * 300_000), (6, "b", "é\r\n\r\nz" * 300_000),
    (None, "q", "a" * 200), (1, "u", "a" * 200), (7, "s", "short"), (8, "s", "short"), (9, "w", "WARC/1.1\r\n\r\n" * 20),
]


def want(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        ref = first.get(h)
        again = ref is not None and i is not None and i > ref
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=str)


def test_archives_of_odd_rows(spark):
    pages = spark.createDataFrame([(*r, "x", "x") for r in ROWS], "page_id long, url string, html string, payload string, count string")
    assert sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=str) == want(ROWS)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_of_the_table(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_warc(spark, small).collect()), key=str) == want(rows)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_chunks_put_a_payload_together(spark, compression):
    out = warc.shared_dir(spark)
    warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string"), out, segment_bytes=100_000, compression=compression)
    chunks = warc.read_archives(spark, out).where("page_id = 5").orderBy("chunk_no").collect()
    assert max(c.chunk_bytes for c in chunks) <= warc.CHUNK_BYTES and [c.chunk_no for c in chunks] == list(range(len(chunks)))
    digest = hashlib.sha256()
    for c in chunks:
        digest.update(c.data)
        assert c.digest_so_far == digest.hexdigest()
    assert b"".join(bytes(c.data) for c in chunks).decode() == ROWS[4][2]
    ids = [r.record_id for r in warc.read_archives(spark, out, with_data=False).where("chunk_no = 0").collect()]
    assert len(ids) == len(set(ids)) == len(ROWS)


def test_records_are_members_of_a_bounded_archive(spark):
    """Each record is a gzip member; a long payload runs through several archives of the series."""
    import glob
    import random
    import zlib

    out = warc.shared_dir(spark)
    long = "".join(random.Random(1).choices("abcdefghij é", k=3_000_000))
    rows = [(i, "u", f"page {i} " * 40) for i in range(200)] + [(500, "u", long)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), out, archive_bytes=500_000, segment_bytes=50_000)
    holders, ids = 0, set()
    for name in glob.glob(f"{out}/part-*"):
        data, found = open(name, "rb").read(), 0
        assert len(data) < 1_500_000
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            data = member.unused_data
            assert member.eof and (not record or (record.startswith(b"WARC/1.1") and record.count(b"WARC-Record-ID") == 1))
            found += b"X-Page-ID: 500\r" in record
            if record:
                ids.add(record.split(b"WARC-Record-ID: ")[1].split(b"\r")[0])
        holders += found > 0
    assert holders >= 3 and len(ids) == 200 + -(-len(long.encode()) // 50_000)
    last = warc.read_archives(spark, out, with_data=False).where("is_last and page_id = 500").collect()
    assert [(r.bytes_so_far, r.digest_so_far) for r in last] == [(len(long.encode()), hashlib.sha256(long.encode()).hexdigest())]


def test_reader_holds_a_chunk_at_a_time():
    """200 MB of payload pass through far less memory than that (the archive's own bytes apart)."""
    import tracemalloc

    body = bytes(200 << 20)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nX-Payload-Length: {len(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    content = memoryview(head.encode() + body + b"\r\n\r\n")
    del body
    tracemalloc.start()
    n = sum(len(piece) for _, _, piece, *_ in warc.record_chunks(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 << 20 and peak < 4 << 20


def test_damage_is_an_error():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\n"
    with pytest.raises(ValueError, match="damaged"):
        list(warc.record_chunks((head + "abc\r\n\r\n").encode()))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.record_chunks(head.encode()))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    seen, counts = docs, []
    for name, stage in p.STAGES:
        out = stage(spark, seen, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        path = warc.shared_dir(spark)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before, after = {r.doc_id for r in seen.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) == out.count()
        counts.append(len(after))
        if name == "toxicity":
            lost = [i for i in before - after if i in labels.index]
            assert labels.toxic[lost].mean() > 0.6 and len(lost) < 0.2 * len(before)
        seen = out
    assert counts[0] > 800 and counts[-1] > 600 and counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_pipeline_on_odd_rows(spark, make, tmp_path):
    import corpus_pipeline as p

    make(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids"} <= set(got.columns)
    assert got.count() == 0 if make is empty_documents else 0 < got.count() <= 16


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns called as the stages' own keep their values."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    names = ["score", "_score", "_spans_", "wins", "keys", "tokens", "found", "family", "block", "links", "rep", "win", "shift"]
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0))).alias(n) for n in names))
    spark.createDataFrame([(1, 1, 0, "x"), (9, 0, 1, "x"), (2, 1, 0, "x"), (10, 0, 1, "x")], "doc_id long, quality int, toxic int, score string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven", "x", "x")], "item_id long, text string, tokens string, wins string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id or 0}" for r in rows for n in names)
    assert p.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 16


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from timeloom.llm import support

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    kept = dict(support._LOCAL)
    support._LOCAL.clear()
    with pytest.raises(RuntimeError, match="checkpoint"):
        support.shared_dir(away)
    support._LOCAL.update(kept)
    assert spark.conf.get("spark.checkpoint.dir", None) is None or "timeloom" not in spark.conf.get("spark.checkpoint.dir")
