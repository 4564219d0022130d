"""Vector codes, mixing and whitening against brute force, and their odd cases."""

import hashlib
import math
from collections import Counter, defaultdict

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import intvectors, mixing, vectorcodes, whitening

VECTORS = "vec_id long, embedding array<float>, label string, code string, error string, x string, entry string, number string, component string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", "e", "x", "y", "z", "w") for i, v, l in rows], VECTORS)


def odd_vectors(n=700, width=12, seed=3):
    """Groups of like vectors with ties, copies, nulls and non-finite components; ids repeat or lack."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, width))
    rows = [(k, (centres[k % 20] + r.normal(scale=0.2, size=width)).round(2).tolist(), None if k % 7 == 0 else f"l{k % 3}") for k in range(n)]
    rows += [(n + k, rows[5][1], "l1") for k in range(n // 2)]  # a third are copies
    rows += [(3, rows[4][1], ""), (None, rows[9][1], "l0"), (None, None, "l0"), (9000, None, None), (9001, [None] * width, "l1"), (9002, [float("nan")] + [0.0] * (width - 1), "l1"), (9003, [float("-inf")] * width, "l1")]
    return rows


def whole(rows, scale):
    return [(i, [math.floor(scale * c) for c in np.asarray(v, np.float32).tolist()], l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute_codes(rows, rounds=4):
    kept = sorted(whole(rows, 1024), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], dtype=np.int64)
    width = x.shape[1] // 4
    books = [x[:256, p * width : (p + 1) * width].copy() for p in range(4)]
    for turn in range(rounds + 1):
        found = [((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2) for p in range(4)]
        entry = [d.argmin(1) for d in found]
        if turn < rounds:
            for p in range(4):
                for e in set(entry[p].tolist()):
                    own = x[entry[p] == e, p * width : (p + 1) * width]
                    books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    error = sum(d.min(1) for d in found)
    sums = defaultdict(int)
    for r, e in zip(kept, error.tolist(), strict=True):
        sums[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()
    return Counter((r[0], "".join(f"{entry[p][k]:02x}" for p in range(4)), int(error[k]), sums[r[2]], sha) for k, r in enumerate(kept))


def test_codes_equal_brute_force(spark):
    rows = odd_vectors()
    got = vectorcodes.vector_codes(table_of(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == brute_codes(rows)


def test_few_rows_and_mixed_lengths(spark):
    rows = [(1, [0.5, 0.25, 1.0], "a"), (2, [0.5, 0.25, 1.0, 2.0, 3.0], "a"), (3, [], None), (4, [-0.3] * 5, None)]
    filled = [(i, v + [0.0] * (8 - len(v)), l) for i, v, l in rows]
    got = vectorcodes.vector_codes(table_of(spark, rows)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(filled)
    assert vectorcodes.vector_codes(table_of(spark, [])).count() == 0
    assert vectorcodes.vector_codes(table_of(spark, [(1, None, "a")])).count() == 0
    assert [r.error for r in vectorcodes.vector_codes(table_of(spark, [(1, [], "a")])).collect()] == [0]


def test_long_components_are_exact_and_too_long_ones_an_error(spark):
    rows = [(k, [float(1 << 16) * (1 if k % 2 else -1), 3.0 * k, 0.25, -7.0 * k], "a") for k in range(300)]
    got = vectorcodes.vector_codes(table_of(spark, rows)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows)
    with pytest.raises(ValueError, match="beyond"):
        vectorcodes.vector_codes(table_of(spark, [(1, [1e30, 0.0, 0.0, 0.0], "a")]))


def test_bounds_spare_distances_and_never_change_a_result(spark):
    rows = table_of(spark, odd_vectors(2000, 8))
    x, length = intvectors.whole_vectors(rows, ["vec_id"], "embedding", 1024, 1 << 27, 4)
    state, books, counts = vectorcodes.learn_codebooks(x, vectorcodes.first_codebooks(x, "vec_id", length), ["vec_id"])
    assert counts[0] == x.count() * 4 * 256
    assert all(c < counts[0] / 4 for c in counts[1:])
    # Bounds hold: no lower bound lies above the true distance to its entry before the last move.
    at = state.select("x", "lower", "upper", "entry").first()
    assert len(at.lower) == 2 * 4 * 256
    plain, _ = vectorcodes.learn_codebooks(x, books, ["vec_id"], 0)[:2]
    a = Counter(map(tuple, vectorcodes.encode(state, books, ["vec_id"]).collect()))
    assert a == Counter(map(tuple, vectorcodes.encode(plain, books, ["vec_id"]).collect()))


def test_bounds_with_equal_distances():
    """Whole-number grids, where ties abound: every round equals a plain search."""
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (500, 3)).astype(np.float64)
    c = r.integers(-3, 4, (40, 3)).astype(np.float64)
    entry, upper, lower, _ = vectorcodes.PartSearch(c, np.zeros(40), np.float64).first(x)
    for _ in range(6):
        new = c + r.integers(-1, 2, c.shape)
        search = vectorcodes.PartSearch(new, np.sqrt(((new - c) ** 2).sum(1)) * vectorcodes.UP, np.float64)
        entry, upper, lower, _ = search.again(x, entry, upper, lower)
        d = ((x[:, None] - new[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all()
        assert (upper**2 >= d.min(1)).all() and (lower**2 <= d).all()
        c = new


def brute_targets(sizes, weights=(5, 2, 1)):
    """Targets by rounds of resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    rest = 1.5 * sum(sizes.values())
    while free and rest > 1e-9:
        heavy = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / heavy
        rest = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def mixed(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    return rows, by


def near(rows):
    """The words taken differ from the target by at most half the longest document."""
    return abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1e-6


def test_mix_meets_targets(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, by = mixed(spark, docs)
    assert len(rows) == docs.count()
    want = brute_targets({s: sum(r.size for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert v[0].source_size == sum(r.size for r in v)
        assert v[0].target == pytest.approx(want[s], rel=1e-12) and near(v)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in v)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000, None: 3}, {"a": 0, "b": 5}, {"z": 1}, {f"s{k}": 3**k for k in range(9)}, {"a": 0}, {"ä": 7, "z": 7, "~": 7, "\U00010000": 7, "￮": 7}])
def test_targets_by_resharing(spark, sizes):
    got = mixing.target_sizes(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(brute_targets(sizes), rel=1e-12)


def test_mix_of_odd_documents(spark):
    docs = data.odd_documents(spark)
    rows, by = mixed(spark, docs)
    assert len(rows) == docs.count() and all(near(v) for v in by.values())
    assert [r.size for r in rows if r.doc_id == 4] == [0] and {r.taken for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert mixing.mix_sources(data.empty_documents(spark)).count() == 0


def test_rows_alike_in_all_are_taken_singly(spark):
    """One row repeated makes up the source: its hash is the threshold, and rows at it are counted out."""
    alike = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("b").alias("source"))
    other = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("five words are in here").alias("text"), F.lit("a").alias("source"))
    rows, by = mixed(spark, alike.unionByName(other))
    assert all(near(v) for v in by.values())
    assert 0 < len({r.taken for r in by["b"]}) <= 2


def test_thresholds_are_nested(spark):
    sized = spark.range(5000).select(F.lit("k").alias("key"), mixing.hashed_order(F.col("id"), F.lit("x")).alias("h"), (F.col("id") % 90 + 1).alias("size"))
    total = sized.agg(F.sum("size")).first()[0]
    budgets = spark.createDataFrame([("k", t, total * p) for t, p in enumerate((0.1, 0.35, 0.9))], "key string, turn int, budget double")
    marks = sorted(mixing.hash_thresholds(sized, budgets).collect(), key=lambda r: r.turn)
    assert [m.threshold for m in marks] == sorted(m.threshold for m in marks)
    for m, p in zip(marks, (0.1, 0.35, 0.9), strict=True):
        got = sized.where(F.col("h") < m.threshold).agg(F.sum("size")).first()[0] or 0
        assert abs(got - p * total) <= 90


def brute_whitening(rows):
    kept = whole(rows, 256)
    x = np.array([r[1] for r in kept], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centre = lambda m: ((m * n - sums).astype(np.float64)) / n
    v = centre(fit).T @ centre(fit) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:4]
    projected = centre(x) @ vectors[:, order] / np.sqrt(values[order])
    return kept, n, [int(d) for d in ((x * n - sums) ** 2).sum(1)], projected, values[order] / np.trace(v)


def check_whitening(spark, rows, partitions=5):
    got = whitening.whitened_vectors(table_of(spark, rows).repartition(partitions)).collect()
    kept, n, deviation, projected, explained = brute_whitening(rows)
    assert len(got) == len(kept) * 4 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    assert {r.component: r.explained for r in got} == pytest.approx(dict(enumerate(explained, 1)), rel=1e-9)
    for k in range(4):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == k + 1)
        for sign in (1, -1):
            theirs = sorted((r[0] is None, r[0] or 0, d, sign * w) for r, d, w in zip(kept, deviation, projected[:, k], strict=True))
            if np.allclose([m[3] for m in mine], [t[3] for t in theirs], atol=1e-7):
                break
        else:
            raise AssertionError(f"component {k + 1}")
        assert [m[:3] for m in mine] == [t[:3] for t in theirs]


def test_whitening_equals_eigenvectors(spark):
    check_whitening(spark, odd_vectors(900, 10))
    check_whitening(spark, odd_vectors(300, 64, seed=8), 70)  # factors are merged more than once


def test_whitening_of_ill_conditioned_vectors(spark):
    """Entries far from the mean and of very unlike spread: a covariance would lose the small ones."""
    r = np.random.default_rng(4)
    rows = [(k, (1e4 + r.normal(size=5) * [3000, 300, 30, 3, 1]).tolist(), "a") for k in range(800)]
    check_whitening(spark, rows)


def test_whitening_of_few_or_flat_vectors(spark):
    flat = [(k, [float(k), 2.0 * k, 1.0], "a") for k in range(40)]
    got = whitening.whitened_vectors(table_of(spark, flat)).collect()
    assert len(got) == 40 * 3
    assert all((r.whitened is None) == (r.component > 1) for r in got) and {r.explained for r in got if r.component > 1} == {0.0}
    one = whitening.whitened_vectors(table_of(spark, [(1, [0.5, 1.0], "a"), (2, [0.5, 1.0], "a")])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, None, 0.0)] * 4
    assert whitening.whitened_vectors(table_of(spark, [])).count() == 0
    assert whitening.whitened_vectors(table_of(spark, [(1, None, "a")])).count() == 0
    huge = whitening.whitened_vectors(table_of(spark, [(k, [2.0**30 * k, 1.0], "a") for k in range(3)])).collect()
    assert {r.deviation for r in huge} == {None, 0}
