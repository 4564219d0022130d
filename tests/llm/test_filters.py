import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from data import empty_documents, odd_documents, prose, words
from pyspark.sql import functions as F

from timeloom.llm import decontam, labelled, quality_gbt, queries, robust_rules, toxicity_fm
from timeloom.llm.textkernel import SPACES, blocks, shingles


def test_kernel_words_and_shingles():
    import pyarrow as pa

    texts = ["", None, " a  b", "a b c d e f", "x", "é 日本\tz\n", "a b c d e f", "b c d e f g"]
    [b] = blocks(pa.array(texts), SPACES)
    spans = [[b.data[s:e].tobytes().decode() for s, e in zip(b.start[i:j], b.end[i:j], strict=True)] for i, j in zip(b.first, b.first[1:], strict=False)]
    assert spans == [words(t) for t in texts]
    g, first = shingles(b)
    assert list(np.diff(first)) == [0, 0, 1, 2, 1, 1, 2, 2]
    assert g[first[3]] == g[first[6]] and g[first[3] + 1] == g[first[7]] and g[first[3]] != g[first[7]]
    assert len(set(b.hash.tolist())) == len({w for t in texts for w in words(t)})
    many = [h.hash for h in blocks(pa.array(texts * 50), SPACES, block_bytes=7)]
    assert np.array_equal(np.concatenate(many), np.tile(b.hash, 50))


def test_threshold_is_centred():
    m, y = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 0.0, 1.0, 1.0])
    assert labelled.centred_threshold(m, y) == 1.5
    assert labelled.centred_threshold(np.zeros(4), y) == 1.0
    assert labelled.centred_threshold(np.zeros(4), np.ones(4)) == -1.0


def held_out_accuracy(spark, folder, query, label, modulus, rest):
    got = query(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")[label]
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() and got.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % modulus == rest for i in got.doc_id] == list(got.held_out)
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    rows = got[got.held_out & got.doc_id.isin(labels.index)]
    return (rows.predicted.to_numpy() == labels[rows.doc_id].to_numpy()).mean()


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01", queries.op3_quality, "quality", 3, 1) > 0.93


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01", queries.op8_toxicity, "toxic", 5, 0) > 0.88


def test_toxicity_learns_pairs():
    """Toxic are two pairs of terms, not the single terms nor other pairs: no linear model can tell."""
    rng = np.random.default_rng(1)
    bits = rng.random((3000, 4)) < 0.4
    y = ((bits[:, 0] & bits[:, 1]) | (bits[:, 2] & bits[:, 3])).astype(float)
    terms = [np.append(np.flatnonzero(r) + 10, 5).astype(np.int32) for r in bits]
    model = toxicity_fm.fit(terms, y)
    doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    right = (model.margins(doc, np.concatenate(terms), len(terms)) >= 0) == (y == 1)
    linear = np.linalg.lstsq(np.c_[bits, np.ones(len(bits))], y, rcond=None)[0]
    assert right.mean() > 0.97 > ((np.c_[bits, np.ones(len(bits))] @ linear >= 0.5) == (y == 1)).mean()


def test_toxicity_learns_exclusive_or():
    """Neither term tells anything alone, among many that tell nothing at all."""
    rng = np.random.default_rng(3)
    bits = rng.random((4000, 2)) < 0.5
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    noise = [rng.choice(20_000, 60, replace=False) + 1000 for _ in bits]
    common = [rng.choice(200, 30, replace=False) + 100 for _ in bits]
    terms = [np.unique(np.concatenate([np.flatnonzero(r) + 10, n, c])).astype(np.int32) for r, n, c in zip(bits, noise, common, strict=True)]
    model = toxicity_fm.fit(terms[:3000], y[:3000])
    rest = terms[3000:]
    doc = np.repeat(np.arange(len(rest)), [len(t) for t in rest])
    assert ((model.margins(doc, np.concatenate(rest), len(rest)) >= 0) == (y[3000:] == 1)).mean() > 0.95


def test_rare_pairs_of_terms():
    """Pairs that one row in two hundred holds, each of their terms being harmless alone: what share is found."""
    rng = np.random.default_rng(11)
    n, pairs = 8000, 20
    y, rows = np.zeros(n), [set(rng.choice(2500, 40).tolist()) for _ in range(n)]
    for p in range(pairs):
        both = rng.choice(n, n // 200, replace=False)
        for i in both:
            rows[i] |= {5000 + 2 * p, 5001 + 2 * p}
            y[i] = 1
        for t in (0, 1):
            for i in rng.choice(np.flatnonzero(y == 0), n // 100, replace=False):
                rows[i].add(5000 + 2 * p + t)
    for i in range(n):  # what fell together by chance is toxic too
        y[i] = float(any(5000 + 2 * p in rows[i] and 5001 + 2 * p in rows[i] for p in range(pairs)))
    terms = [np.array(sorted(r), dtype=np.int32) for r in rows]
    known = toxicity_fm._known(terms, y)
    found = np.mean([5000 + 2 * p in known and 5001 + 2 * p in known for p in range(pairs)])
    model = toxicity_fm.fit(terms[:6000], y[:6000])
    got = toxicity_fm._all_margins(model, terms[6000:]) >= 0
    print("rare pairs", found, (got == (y[6000:] == 1)).mean(), got[y[6000:] == 1].mean())
    assert found >= 0.9 and (got == (y[6000:] == 1)).mean() > 0.95 and got[y[6000:] == 1].mean() > 0.9


def test_cross_validation_prefers_what_generalises():
    rng = np.random.default_rng(6)
    y = (rng.random(600) < 0.4).astype(float)
    terms = [np.unique(np.concatenate([[7] if rng.random() < (0.8 if t else 0.1) else [], rng.choice(300, 20) + 50])).astype(np.int32) for t in y]
    got = toxicity_fm.cross_validate(terms, y, [(5e-3, 40), (5e-3, 0)])
    assert got[5e-3, 40][0] > 0.8 > got[5e-3, 0][0]


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_hash(b):
    """The hash of a word's bytes, eight at a time; those of more than 512 bytes are hashed by blake2b."""
    if len(b) > 512:
        return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
    h = plain_mix(int.from_bytes(b[:8], "little") ^ len(b) * 0x9E3779B97F4A7C15 & M64)
    for k in range(8, len(b), 8):
        h = plain_mix((h * 0xD6E8FEB86659FD93 & M64) ^ int.from_bytes(b[k : k + 8], "little"))
    return h


ODD_TEXTS = [
    "You IDIOT, you", "don't stop-now (really)! a.b.c", "Straße überführt 日本語テキスト", "x" * 600 + " " + "y" * 14 + " " + "z" * 15, "tab\tnew\nline\n\nline\nline", "a a a b b A", "é" * 5 + " ́combining 👩‍👩‍👧", "", " \n ", None,
    "one\x0btwo\x0cthree\rfour five", "\n", "#hash |pipe| [b] 'q' /s/ ;:, ?!.", "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5", "end\n",
]


def test_terms_and_scores_restated(spark):
    """Every word and its beginnings of whole characters, and the sums over all pairs, in plain Python."""
    breaks = r"[\t-\r !-/:-@\[-`{-~]+"

    def plain_terms(text):
        out = set()
        for w in re.split(breaks, text or ""):
            b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w.encode())
            if not b:
                continue
            out.add(plain_hash(b) >> 44)
            for n in toxicity_fm.PREFIX_BYTES:
                head = b[:n].decode(errors="ignore").encode() if len(b) > n else b
                out.add(plain_mix((plain_hash(head) + n) & M64) >> 44)
        return out

    every = sorted(set().union(*map(plain_terms, ODD_TEXTS)))
    rng = np.random.default_rng(0)
    place = np.full(1 << toxicity_fm.BUCKET_BITS, -1, dtype=np.int32)
    known = every[::2]
    place[known] = np.arange(len(known))
    model = toxicity_fm.FactorizationMachine(place, rng.normal(size=len(known)), 0.3 * rng.normal(size=(len(known), 4)), -0.2)
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity_fm.score_toxicity(docs, model).collect()}
    for i, text in enumerate(ODD_TEXTS):
        at = sorted(int(place[t]) for t in plain_terms(text) if place[t] >= 0)
        m = -0.2 + sum(model.w[a] for a in at) + sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(at) for b in at[k + 1 :])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(m, -50, 50)))) < 1e-9, text


def test_statistics_restated():
    from timeloom.llm.textkernel import blocks

    def plain(text):
        b, w = (text or "").encode(), [x.encode() for x in words(text)]
        size, n = [len(x) for x in w], max(1, len(w))
        mean = sum(size) / n
        grams_ = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        lines = b.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        n_lines = max(1, len(lines))
        return [
            *(sum(x in members for x in b) / max(1, len(b)) for members in quality_gbt.CLASSES.values()),
            np.log1p(len(w)), mean, max(0, sum(s * s for s in size) / n - mean**2) ** 0.5,
            1 - (len(w) - len(set(w))) / n, sum(a == c for a, c in zip(w, w[1:], strict=False)) / n, (len(grams_) - len(set(grams_))) / max(1, len(grams_)),
            sum(s == 1 for s in size) / n, sum(s > 14 for s in size) / n, len(w) / n_lines, (len(lines) - len(set(lines))) / n_lines,
        ]

    got = np.concatenate([quality_gbt.statistics_of(b) for b in blocks(pa.array(ODD_TEXTS))])
    want = np.array([plain(t) for t in ODD_TEXTS])
    assert np.allclose(got, want, atol=1e-9), [(i, quality_gbt.STATISTICS[j], got[i, j], want[i, j]) for i, j in np.argwhere(~np.isclose(got, want, atol=1e-9))]


def test_rounds_that_do_not_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(robust_rules, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="still changes"):
        robust_rules.minimum_covariance(spark.createDataFrame([("g", k, k % 3, 0, 0, 1) for k in range(30)], "grp string, " + ", ".join(f"{c} long" for c in robust_rules.VECTOR) + ", n long"))


def test_margins_equal_explicit_pair_sums():
    rng = np.random.default_rng(5)
    place = np.full(1 << toxicity_fm.BUCKET_BITS, -1, dtype=np.int32)
    place[[3, 7, 11, 500]] = range(4)
    model = toxicity_fm.FactorizationMachine(place, rng.normal(size=4), rng.normal(size=(4, 3)), 0.3)
    docs = [[3, 7, 7, 9], [], [500, 11, 7, 3, 3], [42]]
    got = model.margins(np.repeat(np.arange(4), [len(d) for d in docs]), np.array([t for d in docs for t in d], dtype=np.int64), 4)
    for g, d in zip(got, docs, strict=True):
        at = sorted({int(place[t]) for t in d if place[t] >= 0})
        want = 0.3 + sum(model.w[i] for i in at) + sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(g - want) < 1e-9


def test_trees_equal_a_naive_walk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 5))
    model = quality_gbt.fit(x[:400], (x[:400, 1] > 0.2).astype(float), trees=9, depth=3)
    for row, got in zip(x, model.margins(x), strict=True):
        total = model.base
        for t in range(9):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.cut[t, node] else 1)
            total += model.leaf[t, node - 7]
        assert abs(total - got) < 1e-9


def test_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = labelled.training_rows(docs, labels, "toxic", 5, 9).collect()
    assert sorted(map(tuple, got)) == [(1, "t0", 1), (2, "a", 1), (3, "c", 0)]


def test_classifiers_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 2, 3, 4, 5, 9, 10, 11)] + [(None, 1, 1), (12, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for query in (quality_gbt.classify_quality, toxicity_fm.classify_toxicity):
        got = query(odd_documents(spark), labels).toPandas()
        assert len(got) == 16 and got.score.between(0, 1).all() and got.held_out.notna().all()
        assert query(empty_documents(spark), labels).count() == 0
        assert query(odd_documents(spark), labels.limit(0)).count() == 16
    kept = toxicity_fm.score_toxicity(odd_documents(spark), toxicity_fm.fit_toxicity(odd_documents(spark), labels))
    assert dict(kept.dtypes)["score"] == "double" and set(kept.columns) == set(odd_documents(spark).columns)


def test_trees_split_on_the_telling_statistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 2] > 0.3) ^ (x[:, 0] > 0)).astype(float)
    model = quality_gbt.fit(x[:1000], y[:1000])
    assert ((model.margins(x[1000:]) > 0) == (y[1000:] == 1)).mean() > 0.93


def brute_counts(text):
    w = words(text)
    g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(g)
    covered = {j for k, x in enumerate(g) if n[x] > 1 for j in range(k, k + 5)}
    lines = Counter(x for x in (text or "").split("\n") if words(x))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(lines.values()) - len(lines), len(covered)


def check_counts(docs, got):
    want = sorted(brute_counts(t) for t in docs.toPandas().text)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == want
    assert list(got.base_failed) == [r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words for r in got.itertuples()]
    assert not got[got.base_failed].kept.any()


def test_rules_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op9_robust_rules(spark, folder).toPandas()
    check_counts(spark.read.parquet(f"{folder}/documents.parquet"), got)
    m = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    good, bad = m[(m.quality == 1) & ~m.base_failed], m[(m.quality == 0) & ~m.base_failed]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.2


def test_rules_of_odd_rows(spark):
    got = robust_rules.robust_verdicts(odd_documents(spark)).toPandas()
    check_counts(odd_documents(spark), got)
    assert robust_rules.robust_verdicts(empty_documents(spark)).count() == 0


def plain_mcd(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate restated row by row: three starts, ranked distances, rounds until nothing changes."""
    z, floors = q / robust_rules.UNIT, np.diag(np.array(robust_rules.FLOORS) ** 2)
    found = []
    for k, part in enumerate(robust_rules.STARTS):
        mean, cov, before = np.quantile(z, part, axis=0), floors, None
        while True:
            d2 = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
            rank = np.floor(np.log2(d2 + 0.001) * robust_rules.CLASSES)
            edge = np.sort(rank)[int(np.ceil(robust_rules.SUBSET * len(z) - 1e-9)) - 1]
            near = rank <= edge
            mean, cov = z[near].mean(axis=0), np.cov(z[near].T, bias=True) * robust_rules.CONSISTENCY + floors
            if before is not None and (near == before).all():
                break
            before = near
        found.append((np.linalg.det(cov), k, mean, cov))
    return min(found, key=lambda f: f[:2])[2:]


def test_covariance_equals_a_plain_restatement(spark):
    """Groups of many sizes, with junk in them, against numpy."""
    rng = np.random.default_rng(2)
    groups = {f"g{n}": np.concatenate([rng.normal(0, 1, (n, 4)) * [0.5, 1, 1, 1], np.full((n * 3 // 7, 4), 9.0)]) for n in (1, 3, 9, 40, 700)}
    q = {g: np.round(x * robust_rules.UNIT).astype(int) for g, x in groups.items()}
    rows = spark.createDataFrame([(g, *map(int, r), 1) for g, x in q.items() for r in x], "grp string, " + ", ".join(f"{c} long" for c in robust_rules.VECTOR) + ", n long")
    got = robust_rules.minimum_covariance(rows).toPandas().set_index("grp")
    assert set(got.index) == set(groups)
    for g, x in q.items():
        mean, cov = plain_mcd(x)
        assert got["size"][g] == len(x)
        assert np.allclose([got[f"m{i}"][g] for i in range(4)], mean, atol=1e-6), g
        assert np.allclose([got[f"c{i}_{j}"][g] for i, j in robust_rules._PAIRS], [cov[i, j] for i, j in robust_rules._PAIRS], atol=1e-6), g
    assert max(abs(got[f"m{i}"]["g700"]) for i in range(4)) < 0.3


def test_verdicts_equal_a_plain_restatement(spark):
    """``kept`` of every row of a table of small sources, from numpy alone; null is apart from empty."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(600)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("doc_id") % 13 == 1, F.lit("")).otherwise(F.col("source")))
    vectors = robust_rules.statistic_vector(robust_rules.base_counts(docs)).toPandas()
    vectors = vectors[~robust_rules_failed(vectors)]
    q = vectors[robust_rules.VECTOR].to_numpy()
    key = [(r.lang or None, "none" if r.source is None else "x" + r.source) for r in vectors.itertuples()]
    size = Counter(key) + Counter(k[0] for k in key)

    def lent(own, n, parent):
        (m, c), (pm, pc), w = own, parent, n / (n + robust_rules.LENT)
        return w * m + (1 - w) * pm, w * c + (1 - w) * pc + w * (1 - w) * np.outer(m - pm, m - pm)

    table = plain_mcd(q)
    langs = {k: lent(plain_mcd(q[[x[0] == k for x in key]]), size[k], table) for k in {x[0] for x in key}}
    fine = {k: lent(plain_mcd(q[[x == k for x in key]]), size[k], langs[k[0]]) for k in set(key)}
    want = {}
    for i, k, v in zip(vectors.doc_id, key, q / robust_rules.UNIT, strict=True):
        want[i] = float((v - fine[k][0]) @ np.linalg.inv(fine[k][1]) @ (v - fine[k][0]))
    got = robust_rules.robust_verdicts(docs).where("not base_failed").toPandas().set_index("doc_id")
    assert set(got.index) == set(want) and got.kept.nunique() == 2 and len(set(key)) > 40
    assert np.allclose([got.distance[i] ** 2 for i in want], list(want.values()), rtol=1e-5, atol=1e-6)
    assert all(got.kept[i] == (d <= robust_rules.CUT) for i, d in want.items() if abs(d - robust_rules.CUT) > 1e-4)


def robust_rules_failed(v):
    return (v.n_words < 10) | (100 * v.n_repeat_words > 20 * v.n_words)


def test_items_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, folder).collect()}
    docs, items = spark.read.parquet(f"{folder}/documents.parquet").collect(), spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    assert got >= {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    clean = {d.doc_id for d in docs if not any(i.text[:60] in d.text for i in items)}
    assert not clean & {i for i, _ in got}


def test_reparameterised_items(spark):
    item = "the merchant sold 12 apples to Alice and then Alice paid 30 euros for the basket of pears in total"
    bench = spark.createDataFrame([(1, item), (2, "x 3 4 5"), (3, None), (None, item), (1, item), (4, prose(8, 40))], "item_id long, text string")
    other = prose(8, 40).split()
    other[5] = "other"
    docs = spark.createDataFrame(
        [
            (1, "Intro. The merchant sold 45 apples to Carol and then Carol paid 99 miles for the basket of pears, in total. End"),
            (2, "The merchant sold 45 apples to Carol and then Bob paid 99 euros for the basket of pears in total"),
            (3, item), (4, None), (5, "1 2 3 4 5 6 7 8"), (6, prose(9, 300)), (7, "lead " + " ".join(other)), (None, item),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_changed) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (5, 5), (3, 1): (5, 0), (7, 4): (0, 0)}
    assert sorted(r.doc_id or 0 for r in decontam.remove_contaminated(docs, decontam.contaminated(docs, bench)).collect()) == [0, 2, 4, 5, 6]


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, prose(1, 120))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(odd_documents(spark), bench).collect()) == [1, 2, 3, 11]
    assert decontam.contaminated(empty_documents(spark), bench).count() == 0
    assert decontam.contaminated(odd_documents(spark), bench.limit(0)).count() == 0


def test_items_after_variants_of_themselves(spark):
    """An inconsistent variant before, after or beside a consistent one does not hide it."""
    item = "the merchant sold 12 apples to Alice and then Alice paid 30 euros for the basket of pears in total"
    good = "the merchant sold 45 apples to Carol and then Carol paid 99 euros for the basket of pears in total"
    bad = "the merchant sold 45 apples to Carol and then Bob paid 99 euros for the basket of pears in total"
    short, plain, odd = "so give 7 plums and 7 figs", "so give 9 plums and 9 figs", "so give 8 plums and 9 figs"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    rows = {1: f"{bad} {item}", 2: f"{item} {bad}", 3: f"{bad} {prose(1, 40)} {good}", 4: f"{bad} {bad}", 5: f"{prose(2, 500)} {bad} {bad} {good} {bad}", 6: f"{odd} {plain}", 7: f"{odd} {odd}", 8: f"{odd} {short} {odd}"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_changed) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (5, 0), (2, 1): (5, 0), (3, 1): (5, 4), (5, 1): (5, 4), (6, 2): (2, 2), (8, 2): (2, 0)}


def test_names_that_begin_sentences_and_long_insertions(spark):
    item = "Alice has 5 apples. Bob gives her 3 more. How many apples does Alice have now?"
    told = prose(5, 60)
    bench = spark.createDataFrame([(1, item), (2, told)], "item_id long, text string")
    rows = {
        1: item.replace("Alice", "Carol").replace("Bob", "Dave"), 2: "He said:\n" + item.replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "9"),
        3: item.replace("does Alice", "does Erin").replace("Alice", "Carol"), 4: item.lower(), 5: f"{prose(6, 30)}. {item}", 6: "So Carol has 5 apples. Then Dave gives her 3 more. How many apples does Carol have now?",
        7: " ".join([*told.split()[:30], prose(7, 40), *told.split()[30:]]), 8: " ".join([*told.split()[:30], prose(8, 400), *told.split()[:20]]),
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_changed) for r in decontam.contaminated(docs, bench).collect()}
    assert got.keys() == {(1, 1), (2, 1), (4, 1), (5, 1), (7, 2)}  # case alone makes no other text
    assert got[5, 1][1] == got[4, 1][1] == 0 and got[1, 1] == (4, 2) and got[2, 1] == (4, 3)


def test_small_sources_and_tables_are_judged(spark):
    odd = " ".join(f"#{w}$%&" for w in prose(1, 80).split())
    line = prose(2, 17)
    repeats = f"{line} {prose(3, 150)} {line}"
    rare = [(900 + i, prose(900 + i, 100), "en", "rare") for i in range(8)] + [(1, odd, "en", "rare"), (2, repeats, "en", "rare"), (3, odd, "xx", None)]
    big = [(1000 + i, prose(1000 + i, 100), "en", "web") for i in range(220)]
    schema = "doc_id long, text string, lang string, source string"
    for rows in (rare, big + rare):
        got = robust_rules.robust_verdicts(spark.createDataFrame(rows, schema)).toPandas().set_index("doc_id")
        assert not got.base_failed.any() and got.distance.notna().all()
        assert set(got.index[~got.kept]) == {1, 2, 3}
    assert abs(robust_rules.CUT - 23.51) < 0.01


def test_slots_of_another_kind_fail(spark):
    """A literal where the item has a name, or a name where it has a number, is no copy; repeated ids don't add up."""
    item = "the merchant sold 12 apples to Alice and then the clerk of the old shop paid for the large basket of ripe pears in total and went home"
    first, second = prose(71, 24).split(), prose(72, 24).split()
    bench = spark.createDataFrame([(1, item), (2, " ".join(first)), (2, " ".join(second))], "item_id long, text string")
    rows = {
        1: item, 2: item.replace("Alice", "somebody"), 3: item.replace("12", "Carol"), 4: " ".join(first[:13] + second[-11:]), 5: " ".join(second),
        6: item.replace("sold 12", "sold exactly 12").replace("paid for", "paid in cash for"), 7: item.replace("12", "77").replace("to Alice", "only to Erin"),
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_slots, r.n_changed) for r in decontam.contaminated(docs, bench, similarity=0.6).collect()}
    assert got == {(1, 1): (2, 0), (5, 2): (0, 0), (6, 1): (2, 0), (7, 1): (2, 2)}


def test_short_items_and_tables_of_numbers(spark):
    bench = spark.createDataFrame([(1, "what is two plus"), (2, "hello"), (3, "1 2 3 4 5 6 7"), (4, "Pay Bob 7"), (5, "two words"), (6, "..."), (7, "a 12345678901234567890123456 kg box of figs")], "item_id long, text string")
    rows = {
        1: "So: what is two plus three?", 2: "hello there", 3: "Hello!", 4: "9 1 2 3 4 5 6 7", 5: "1 2 3 4 5 6 8", 6: "they pay Bob 7 now", 7: "they pay Carol 9 now",
        8: "two words", 9: "two words more", 10: None, 11: "send a 98765432109876543210987654 lb box of figs",
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1), (3, 2), (4, 3), (6, 4), (8, 5), (11, 7)}


def plain_tokens(text):
    """Kinds of the words of lower-case prose with numbers and mid-sentence names, restated in Python."""
    out, before = [], ""
    for w in words(text):
        if re.fullmatch(r"[0-9]+", w):
            out.append(("n", w))
        elif w[0].isupper() and re.search(r"[a-z0-9,]$", before):
            out.append(("p", w.lower()))
        else:
            out.append((w.lower(), w.lower()))
        before = w
    return out


def test_items_equal_brute_force(spark):
    """All pairs of documents and items with planted variants: replaced values, lost and inserted words."""
    rng = np.random.default_rng(4)
    names, items, docs = [f"N{a}x" for a in "abcdefgh"], {}, {}
    for i in range(12):
        w = prose(200 + i, 40).split()
        for k in (5, 12, 20, 28, 35):
            w[k] = str(rng.integers(1, 99)) if k % 2 else names[rng.integers(0, 8)]
        w[28] = w[12]
        items[i] = w
    for d in range(120):
        i = int(rng.integers(0, 12))
        w, kind = list(items[i]), d % 6
        if kind in (1, 2):  # re-parameterised, once with one value in two places and once not
            w[12] = w[28] = "Zed"
            w[5] = "777"
            w[28] = "Zed" if kind == 1 else "Yan"
        if kind == 3:
            for k in rng.choice(40, 4, replace=False):
                w[k] = f"edit{k}" if k not in (5, 12, 20, 28, 35) else w[k]
        if kind == 4:
            w = w[: int(rng.integers(20, 40))]
        if kind == 5:
            w = prose(900 + d, 40).split()
        docs[d] = " ".join([*prose(500 + d, 30).split(), *w, *prose(700 + d, 30).split()])
    docs |= {200: docs[1], 201: " ".join(items[0] + items[1])}

    def found(text, item):
        a, b = plain_tokens(" ".join(item)), plain_tokens(text)
        grams = {}
        for k in range(len(b) - 4):
            grams.setdefault(tuple(x[0] for x in b[k : k + 5]), []).append(k)
        hits = [(k, p) for k in range(len(a) - 4) for p in grams.get(tuple(x[0] for x in a[k : k + 5]), [])]
        if len({tuple(x[0] for x in a[k : k + 5]) for k, _ in hits}) < 0.8 * len({tuple(x[0] for x in a[k : k + 5]) for k in range(len(a) - 4)}):
            return False
        shift = {p - k for k, p in hits}
        assert len(shift) == 1  # edits of this test move nothing
        s = shift.pop()
        seen = {}
        for k in range(min(k for k, _ in hits), max(k for k, _ in hits) + 5):
            if a[k][0] in ("n", "p"):
                if b[k + s][0] != a[k][0] or seen.setdefault(a[k], b[k + s][1]) != b[k + s][1]:
                    return False
        return True

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {(d, i) for d, t in docs.items() for i, w in items.items() if found(t, w)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(table, bench).collect()} == want
    assert 40 < len(want) < 100
