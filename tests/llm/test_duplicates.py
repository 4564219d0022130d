import random
from collections import Counter, defaultdict

import pytest
from data import empty_documents, grams, odd_documents, prose, words

from timeloom.llm import components, jaccard, queries, substring


def test_banding_reaches_its_recall():
    b = jaccard.Banding.for_recall(0.8, 0.999)
    assert 1 - (1 - 0.8**b.rows) ** b.bands >= 0.999 and b.bands * b.rows <= 144
    with pytest.raises(ValueError):
        jaccard.Banding.for_recall(0.1, 0.999999, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 2), (9, 9), (None, 4), (7, 5), (7, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1, 5: 5, 7: 5}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows: dict[int, str]) -> tuple[Counter, dict[int, int]]:
    sets, inverse, common = {i: grams(t) for i, t in rows.items()}, defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            inverse[g].append(i)
    for ids in inverse.values():
        for k, b in enumerate(ids):
            for a in ids[:k]:
                common[a, b] += 1
    links, up = Counter(), {i: i for i in rows}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return links, {i: root(i) for i in rows}


def test_jaccard_query_equals_brute_force(spark, small):
    got = queries.op10_jaccard(spark, small).toPandas()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    links, classes = brute_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.itertuples()} == {i: (classes[i], links[i]) for i in rows}


def test_jaccard_of_a_large_family(spark, monkeypatch):
    """A family in several blocks, with copies: all links count, and pairs are no rows."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    base = prose(5, 300).split()
    rows = {}
    for i in range(60):
        w = list(base)
        w[(7 * i) % 300] = f"own{i % 50}"
        rows[i] = " ".join(w)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    links, classes = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {i: (classes[i], links[i]) for i in rows}
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each(docs, jaccard.jaccard_classes(docs)).collect()) == sorted(set(classes.values()))


def test_jaccard_of_odd_rows(spark):
    got = jaccard.jaccard_classes(odd_documents(spark)).toPandas()
    assert len(got) == 16
    by = {int(r.doc_id): (r.class_id, r.n_links) for r in got.itertuples() if r.doc_id == r.doc_id}
    assert by[1] == (1, 2) and by[2] == (1, 2) and by[3] == (1, 2)
    assert all(by[i] == (i, 0) for i in (4, 5, 6, 7, 8, 9, 10, 12))
    kept = jaccard.keep_one_of_each(odd_documents(spark), jaccard.jaccard_classes(odd_documents(spark)))
    assert kept.columns == odd_documents(spark).columns and kept.where("doc_id in (2, 3)").count() == 0 and kept.where("doc_id is null").count() == 2
    assert jaccard.jaccard_classes(empty_documents(spark)).count() == 0


def exact_runs(rows: dict[int, str], n: int) -> dict[int, set[int]]:
    """Words of each document in runs of n words that an earlier document holds."""
    seen, marks = {}, defaultdict(set)
    for i in sorted(rows):
        w = words(rows[i])
        for a in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[a : a + n]), i) != i:
                marks[i].update(range(a, a + n))
    return dict(marks)


def test_passages_of_the_table(spark, small):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = defaultdict(set)
    for r in queries.op5_repeated_passages(spark, small).collect():
        assert r.ref_doc_id < r.doc_id and 0 <= r.start_word and r.start_word + r.n_words <= len(words(rows[r.doc_id]))
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    must = exact_runs(rows, 50)
    assert must and all(m <= got[i] for i, m in must.items())


def test_compact_windows_equal_the_recursion():
    import numpy as np

    rng = np.random.default_rng(0)
    for length, sizes in ((4, [0, 3, 4, 50, 1, 30]), (7, [6, 7, 100])):
        first = np.concatenate([[0], np.cumsum(sizes)])
        value = rng.integers(1, 2**62, first[-1], dtype=np.uint64)
        want = set()

        def split(a: int, b: int) -> None:
            if b - a >= length:  # noqa: B023
                c = a + int(value[a:b].argmin())  # noqa: B023
                want.add((c, a, b - 1))  # noqa: B023
                split(a, c)
                split(c + 1, b)

        for a, b in zip(first[:-1], first[1:], strict=True):
            split(int(a), int(b))
        assert {tuple(map(int, x)) for x in zip(*substring.compact_windows(value, first, length), strict=True)} == want


def test_repeats_fold_into_series():
    import numpy as np

    key = np.array([5, 7, 5, 5, 7, 5, 9], dtype=np.uint64)
    row, step, times = substring._fold_repeats(key, np.array([0, 1, 10, 20, 21, 50, 60]))
    got = {(int(r), int(s), int(t)) for r, s, t in zip(row, step, times, strict=True)}
    assert got == {(0, 10, 3), (1, 20, 2), (5, 0, 1), (6, 0, 1)}


def test_common_and_edited_passages(spark):
    """One passage in many documents, each with its own context, and one with an edited word."""
    passage, far = prose(11, 60), prose(12, 90).split()
    edited = list(far)
    edited[45] = "edited"
    rows = {i: f"{prose(100 + i, 40)} {passage} {prose(300 + i, 40)}" for i in range(40)}
    rows |= {100: f"{prose(901, 70)} {' '.join(far)}", 101: f"{' '.join(edited)} {prose(902, 70)}", 102: prose(903, 200), 103: "a b c d e f g " * 60, 104: "a b c d e f g " * 60}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = substring.repeated_passages(docs).toPandas()
    assert set(got.doc_id) == set(range(1, 40)) | {101, 104}
    common = got[got.doc_id < 40]
    # One document has the word before the passage in common with another by chance.
    assert list(zip(common.start_word, common.n_words, strict=True)).count((40, 60)) == 38 and common.n_words.between(60, 61).all()
    assert list(got[got.doc_id == 101].n_words) == [90]
    cut = {r.doc_id: r for r in substring.remove_passages(docs.withColumn("n_chars", docs.doc_id), substring.repeated_passages(docs)).collect()}
    assert cut[0].text == rows[0] and cut[102].text == rows[102]
    assert len(words(cut[5].text)) <= 100 and all(r.n_chars == len(r.text) for i, r in cut.items() if i in (5, 101))
    assert 104 not in cut or len(words(cut[104].text)) <= 30


def test_passages_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = substring.repeated_passages(docs).toPandas()
    assert set(got.doc_id) == {2, 3, 11}
    out = substring.remove_passages(docs, substring.repeated_passages(docs))
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[4] is None and left[5] == "" and left[1] is not None and len(words(left.get(11))) >= 200 and len(words(left.get(2) or "")) < 12
    assert substring.repeated_passages(empty_documents(spark)).count() == 0
    assert substring.remove_passages(empty_documents(spark), substring.repeated_passages(empty_documents(spark))).count() == 0


def test_neighbouring_lines_of_different_documents_are_no_passage(spark):
    """Three common lines in a row, each from another document, are held by none as a whole."""
    one, two, three = prose(21, 30), prose(22, 30), prose(23, 30)
    rows = {1: f"{one} {prose(31, 60)}", 2: f"{prose(32, 60)} {two}", 3: f"{three} {prose(33, 60)}", 4: f"{prose(34, 40)} {one} {two} {three} {prose(35, 40)}"}
    # The same lines far apart in one document are no passage either.
    rows |= {5: f"{prose(41, 40)} {prose(42, 30)} {prose(43, 40)} {prose(44, 30)}", 6: f"{prose(45, 40)} {prose(44, 30)} {prose(42, 30)} {prose(46, 40)}"}
    rows |= {7: f"{prose(51, 60)} {prose(52, 60)}", 8: f"{prose(53, 20)} {prose(52, 60)} {prose(51, 60)}"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {(r.doc_id, r.start_word, r.n_words, r.ref_doc_id, r.ref_start_word) for r in substring.repeated_passages(docs).collect()} == {(8, 20, 60, 7, 60), (8, 80, 60, 7, 0)}
    for r in substring.repeated_passages(docs).collect():
        w, ref = words(rows[r.doc_id]), words(rows[r.ref_doc_id])
        assert r.doc_id == 8 and w[r.start_word : r.start_word + r.n_words] == ref[r.ref_start_word : r.ref_start_word + r.n_words]


def test_common_run_inside_a_rarer_passage(spark):
    """Runs of 41 words in six documents each, and a passage of 50 around each run that two more documents share."""
    rows = {}
    for r in range(36):
        # k words of the passage stand before the run, so that it lies otherwise around the run's centre.
        run, k = prose(60 + r, 41), r % 10
        left, right = prose(3000 + r, k), prose(4000 + r, 9 - k)
        for j in range(8):
            i = 10 * r + j
            rows[i] = f"{prose(5000 + i, 40)} {left if j > 5 else ''} {run} {right if j > 5 else ''} {prose(9000 + i, 40)}"
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = exact_runs(rows, 50)
    assert set(want) == {10 * r + 7 for r in range(36)}
    # One hash function: each has to find every passage by itself.
    for hashes in (1, 3):
        got = defaultdict(set)
        for r in substring.repeated_passages(docs, hashes=hashes).collect():
            assert r.ref_doc_id == r.doc_id - 1
            w, ref = words(rows[r.doc_id]), words(rows[r.ref_doc_id])
            assert w[r.start_word : r.start_word + r.n_words] == ref[r.ref_start_word : r.ref_start_word + r.n_words]
            got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        assert set(got) == set(want) and dict(got) == want


@pytest.mark.parametrize("most", [None, 20])
def test_passage_of_the_least_length_around_a_common_run(spark, monkeypatch, most):
    """Runs of 41 to 52 words in twelve documents, and one to nine words more around each that two of them share alone.

    ``most``: also if a task holds so few windows of a signature that they are dealt out by their keys.
    """
    meetings = substring._meetings
    monkeypatch.setattr(substring, "_meetings", lambda grams: meetings(grams, *([most] if most else [])))
    rows, want, r = {}, set(), random.Random(8)
    for g, (run_words, more) in enumerate((n, 50 + extra - n) for n in range(41, 53) for extra in range(3) for _ in range(3)):
        run, k = prose(100 + g, run_words), r.randrange(max(1, more + 1))
        left, right = prose(3000 + g, k), prose(4000 + g, max(0, more - k))
        pair = sorted(r.sample(range(12), 2))
        for j in range(12):
            i = 100 * g + j
            rows[i] = f"{prose(20_000 + i, r.randrange(30, 60))} {left if j in pair else ''} {run} {right if j in pair else ''} {prose(60_000 + i, r.randrange(30, 60))}"
        want.add(100 * g + pair[1])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for hashes in (1, 3):
        got = defaultdict(set)
        for p in substring.repeated_passages(docs, hashes=hashes).collect():
            w, ref = words(rows[p.doc_id]), words(rows[p.ref_doc_id])
            assert p.n_words >= 50 and w[p.start_word : p.start_word + p.n_words] == ref[p.ref_start_word : p.ref_start_word + p.n_words]
            got[p.doc_id].update(range(p.start_word, p.start_word + p.n_words))
        must = exact_runs(rows, 50)
        assert want <= set(must) and set(got) == set(must)
        assert all(len(m & got[i]) >= 50 for i, m in must.items())
        assert all(got[i] >= must[i] for i in want if i // 100 < 9 * 9)  # nobody else holds 50 of these words


def test_many_windows_of_one_signature_take_linear_time_and_bounded_memory():
    """Batches of windows of one signature, each with other surroundings: late ones cost what early ones do."""
    import time
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)

    def batches(n):
        for b in range(n):
            place, series = substring._pack(np.full(10_000, 60), np.zeros(10_000, np.int64), np.ones(10_000, np.int64), np.full(10_000, 48), np.full(10_000, 48))
            sketch = r.integers(-(2**62), 2**62, (10_000, 4))
            columns = [np.full(10_000, 16), np.arange(10_000) + 10_000 * b, place, series, *sketch.T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=substring._PACKED_FIELDS)

    took, rows, began = [], 0, time.process_time()
    tracemalloc.start()
    for out in substring._meetings(46)(batches(200)):
        rows += int((out.column("kind").to_numpy() == 2).sum())
        if rows // 500_000 > len(took):
            took.append(time.process_time() - began)
    assert rows == 2_000_000
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    gaps = np.diff(took)
    assert gaps.max() < 3 * gaps.min() + 1


def test_recall_of_edited_passages(spark):
    """Words replaced, inserted and left out: at least 0.95 of the planted passages are found, and no clean document."""
    r = random.Random(3)
    rows, want, i = {}, {}, 0
    for kind, size, edits in (("exact", 60, 0), ("replace", 60, 1), ("insert", 60, 1), ("lose", 60, 1), ("replace", 100, 2), ("insert", 100, 2), ("lose", 100, 2)):
        for _ in range(60):
            w = prose(10_000 + i, size).split()
            e = list(w)
            for k in sorted(r.sample(range(8, size - 8), edits), reverse=True):
                e[k : k + (kind != "insert")] = [] if kind == "lose" else [f"new{k}"]
            rows[2 * i], rows[2 * i + 1] = f"{prose(30_000 + i, 50)} {' '.join(w)} {prose(40_000 + i, 30)}", f"{prose(50_000 + i, 30)} {' '.join(e)} {prose(60_000 + i, 60)}"
            want[2 * i + 1] = (kind, edits, len(e))
            i += 1
    rows |= {5000 + k: prose(80_000 + k, 150) for k in range(50)}
    got = defaultdict(int)
    for p in substring.repeated_passages(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect():
        assert p.n_words >= 50 and p.ref_doc_id == p.doc_id - 1
        got[p.doc_id] = max(got[p.doc_id], p.n_words)
    assert set(got) <= set(want)
    by = defaultdict(list)
    for d, (kind, edits, n) in want.items():
        by[kind, edits].append(got[d] >= n - 6)
    assert all(sum(found) >= 0.95 * len(found) for found in by.values()), {k: sum(v) / len(v) for k, v in by.items()}
    assert all(by["exact", 0])


def test_nothing_below_the_least_length(spark):
    rows = {}
    for i in range(60):
        passage = prose(i, 45 + i % 5)
        rows[2 * i], rows[2 * i + 1] = f"{prose(1000 + i, 40)} {passage} {prose(2000 + i, 40)}", f"{prose(3000 + i, 40)} {passage} {prose(4000 + i, 40)}"
    assert substring.repeated_passages(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).count() == 0


def test_windows_across_the_seam(monkeypatch):
    """Texts of more n-grams than a segment lose no window: every stretch of the least length still holds a centre it shares."""
    import numpy as np

    monkeypatch.setattr(substring, "SEGMENT", 64)
    value = np.random.default_rng(1).integers(1, 2**62, 1000, dtype=np.uint64)
    first = np.array([0, 300, 310, 1000])
    at, left, right = substring.compact_windows(value, first, 16)
    have = {(int(c), int(a), int(b)) for c, a, b in zip(at, left, right, strict=True)}
    for begin, end in zip(first[:-1], first[1:], strict=True):
        for k in range(int(begin), int(end) - 15):
            centre = k + int(value[k : k + 16].argmin())
            assert any(c == centre and a <= k and b >= k + 15 for c, a, b in have)
