import zlib

import numpy as np
import pytest
from data import empty_documents, odd_documents

from timeloom.llm import queries, sharding, spm, tokenfiles

public_tokenizers = pytest.importorskip("public_tokenizers")


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_jump_hash(spark):
    keys = [0, 1, 2, 41, -1, -(2**63), 2**63 - 1, *range(1000, 1400)]
    got = sharding.assign_shards(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", 40).collect()
    assert [(r.shard, r.grown_shard) for r in got] == [(jump(r.doc_id, 40), jump(r.doc_id, 41)) for r in got]
    assert all(r.grown_shard in (r.shard, 40) for r in got)


def test_shard_query(spark, small):
    got = queries.op1_sharding(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.doc_id) == sorted(docs.index)
    assert [zlib.crc32(docs.text[i].encode()) for i in got.doc_id] == list(got.text_crc32)
    assert [len(docs.text[i].encode()) + 16 for i in got.doc_id] == list(got["size"])
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_shards_of_odd_rows(spark):
    got = sharding.shard_documents(odd_documents(spark)).toPandas()
    assert len(got) == 16 and sorted(got[got.doc_id.isin([4, 5])]["size"]) == [16, 16]
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert sharding.shard_documents(empty_documents(spark)).count() == 0


def test_token_files_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs, rows in ((spark.read.parquet(f"{small}/documents.parquet"), None), (odd_documents(spark).where("doc_id is not null and doc_id <> 13"), 12)):
        got = tokenfiles.encode_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).toPandas().sort_values("doc_id")
        texts = docs.toPandas().sort_values("doc_id").text
        ids = [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert rows in (None, len(got))
        assert list(got.n_tokens) == [len(i) for i in ids]
        assert list(got.ids_crc32) == [zlib.crc32(np.array(i, "<u4")) for i in ids]
        assert list(got.start) == [int(x) for x in np.cumsum([0] + [len(i) for i in ids])[:-1]]


def test_token_files_select_columns(spark, small):
    out = tokenfiles.shared_dir(spark)
    tokenfiles.write_token_files(odd_documents(spark), public_tokenizers.path("word_bpe_49k.json"), out)
    meta = tokenfiles.read_token_files(spark, out, ["doc_id", "start", "n_tokens"])
    assert "ids" not in meta._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0].split("Project")[-1]
    assert meta.count() == 16 and meta.where("n_tokens = 1").count() == 4
    assert tokenfiles.encode_round_trip(empty_documents(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("text", ["a\x0bb", "a\x0cb", "x́ ́y", "<|endoftext|> a", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "don't 's it's", " a b\x1cc", "", "İI ǅ É É", "H\u0331a h\u0331a H\u0331A J\u030c j\u030c", "Abc.,x. Y, ###. a.5b"])
def test_word_encoder_on_odd_texts(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    [(_, flat, _)] = tokenfiles.WordEncoder(path).encode_column(pa.array([text]))
    assert list(flat) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_pieces_equal_the_library(spark, small):
    import random

    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), spm.Encoder(path)
    r = random.Random(3)
    texts = ["", " ", "   x", "a\nb\tc", "▁x y▁ z", "x\r\n);\r\n", "日本 語", "\x00", " " * 33, "a" * 5000, "".join(r.choice("abcdehilmn") for _ in range(3000))]
    texts += ["".join(r.choice("abcdefgehilmnorstuv   .,(){}\r\n\t0123éß日▁-_=<>/\"'") for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += [t for t in spark.read.parquet(f"{small}/documents.parquet").toPandas().text]
    flat = [ids for _, f, n in own.encode_column(pa.array(texts)) for ids in np.split(f, np.cumsum(n)[:-1])]
    assert [list(map(int, f)) for f in flat] == library.encode(texts)
    back = spm.decode_ids(own.v, np.concatenate(flat).astype(np.int64), np.array([len(f) for f in flat]))
    assert [b.decode() for b in back] == [t.replace("▁", " ") for t in texts]


def thue_morse(n: int) -> tuple[str, str]:
    """A word of n letters and its complement, which sums of byte values times powers can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_complementary_words_keep_their_own_ids():
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    words_path, pieces_path = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [t for n in (1024, 2048, 4096) for a, b in [thue_morse(n)] for t in (a, b, f"{a} {a}", f"{a} {b}")]
    for own, want in (
        (tokenfiles.WordEncoder(words_path), [e.ids for e in Tokenizer.from_file(words_path).encode_batch(texts, add_special_tokens=False)]),
        (spm.Encoder(pieces_path), sentencepiece.SentencePieceProcessor(model_file=pieces_path).encode(texts)),
    ):
        for column in (texts, texts[::-1]):
            flat = [list(map(int, ids)) for _, f, n in own.encode_column(pa.array(column)) for ids in np.split(f, np.cumsum(n)[:-1])]
            assert flat == (want if column is texts else want[::-1])


def test_hashes_that_collide_change_no_ids(monkeypatch):
    """Even if most words share a hash, ids are the library's: bytes are compared."""
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    from timeloom.llm import textkernel

    real = textkernel.hash_ranges
    few = lambda data, start, end: real(data, start, end) % np.uint64(14)
    monkeypatch.setattr(textkernel, "hash_ranges", few)
    monkeypatch.setattr(spm, "hash_ranges", few)
    texts = ["the cat sat on a mat", "", "12 cats, 13 dogs (or more)!", "mat a on sat cat the", "odd"] * 3
    words_path, pieces_path = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for own, want in (
        (tokenfiles.WordEncoder(words_path), [e.ids for e in Tokenizer.from_file(words_path).encode_batch(texts, add_special_tokens=False)]),
        (spm.Encoder(pieces_path), sentencepiece.SentencePieceProcessor(model_file=pieces_path).encode(texts)),
    ):
        assert [list(map(int, ids)) for _, f, n in own.encode_column(pa.array(texts)) for ids in np.split(f, np.cumsum(n)[:-1])] == want


def unigram_model(path, bytes_too: bool, seed: int = 5) -> list[str]:
    """Write a unigram model file with random scores, put together by hand; returns its letters."""
    import random
    import struct

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(tag: int, value: bytes | int) -> bytes:
        return number(tag << 3) + number(value) if isinstance(value, int) else number(tag << 3 | 2) + number(len(value)) + value

    r = random.Random(seed)
    letters = list("abcdeéß日")
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if bytes_too:
        pieces += [(f"<0x{b:02X}>", -30.0, 6) for b in range(256)]
    own = {x for x in [*letters, "▁", *("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(300))]}
    own |= {"▁" + x for x in sorted(own)[:150]}
    pieces += [(x, -r.uniform(2, 12) - 1.5 * len(x) ** 0.5, 1) for x in sorted(own) if x != "ß"]
    body = b"".join(field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, 1) + field(35, int(bytes_too))
    path.write_bytes(body + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)))
    return letters


@pytest.mark.parametrize("bytes_too", [True, False])
def test_unigram_search_equals_the_library(tmp_path, bytes_too, monkeypatch):
    """Sums of scores choose the path, in a window that is bounded however long the text is."""
    import random

    import pyarrow as pa
    import sentencepiece

    letters = unigram_model(tmp_path / "m.model", bytes_too)
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    own = spm.Encoder(str(tmp_path / "m.model"))
    assert not own.v.by_merges
    r = random.Random(1)
    texts = ["", " ", "zz", "a zz b", "z▁z", "x" * 30] + ["".join(r.choice([*letters, " ", "z", "Q"]) for _ in range(r.randint(1, 200))) for _ in range(300)]
    texts += ["".join(r.choices(letters, k=6000))]
    assert [list(map(int, ids)) for _, f, n in own.encode_column(pa.array(texts)) for ids in np.split(f, np.cumsum(n)[:-1])] == library.encode(texts)
    monkeypatch.setattr(spm, "COMMIT_EVERY", 16)
    widest = []
    for n in (2000, 20_000):
        search = spm.StreamingViterbi(own.v)
        text = "".join(r.choices(letters, k=n))
        assert search.encode("▁" + text) == library.encode(text)
        widest.append(search.widest)
    assert max(widest) < 200


def test_search_commits_early():
    """The paths that the window keeps are forgotten; what is committed is the whole text's."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    search = spm.StreamingViterbi(spm.Vocabulary(path))
    text = "thequickbrownfoxjumpsover" * 4000
    stream = search.pieces(text)
    next(stream)
    # The first piece comes out before the text is read to its end.
    assert stream.gi_frame.f_locals["end"] == spm.COMMIT_EVERY
    assert "".join(search.pieces(text)) == text and search.widest < 2 * spm.COMMIT_EVERY + search.v.longest


def test_pieces_of_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = spm.encode_documents(odd_documents(spark), path)
    assert encoded.count() == 16 and encoded.where("n_tokens = 0").count() == 3
    decoded = spm.decode_documents(encoded, path)
    assert decoded.where("decoded <> coalesce(text, '')").count() == 0
    assert spm.encoding_digests(odd_documents(spark), path).where("not round_trip").count() == 0
    assert spm.encode_documents(empty_documents(spark), path).count() == 0


@pytest.mark.parametrize("bits", [1, 20])
def test_known_ranges_are_found_without_sorting(monkeypatch, bits):
    """Also where most ranges share their slot with another, and where two ranges share a hash."""
    import numpy as np

    from timeloom.llm import idpool, textkernel

    monkeypatch.setattr(idpool, "SLOT_BITS", bits)
    words = [f"w{k % 40}x{k % 7}" for k in range(500)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    key = textkernel.hash_ranges(data, start, end)
    learnt = lambda rows: (np.concatenate([data[start[r] : end[r]] for r in rows]).astype(np.int32), (end - start)[rows])
    pool = idpool.IdPool(np.int32)
    for _ in range(2):
        flat, ends, wrong = pool.encode(data, start, end, key, learnt)
        assert not wrong.any() and flat.tolist() == data.tolist() and ends.tolist() == [0, *end.tolist()]
    if bits == 20:
        sorted_, real = [], np.unique
        monkeypatch.setattr(idpool.np, "unique", lambda x, **options: (sorted_.append(len(x)), real(x, **options))[1])
        assert pool.encode(data, start, end, key, learnt)[0].tolist() == data.tolist() and sum(sorted_) < 10
    monkeypatch.undo()
    one = np.full(len(key), 7, np.uint64)
    flat, ends, wrong = idpool.IdPool(np.int32).encode(data, start, end, one, learnt)
    assert wrong.tolist() == [w != words[0] for w in words]
