"""Hand-made rows and plain restatements of the operators that depend on order."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from timeloom.functions import scalars
from timeloom.operators import ledger, models, ranges, scoring, select, text, timeline


def paras(spark, rows, **options):
    df = spark.createDataFrame([("v", i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)], "video_id string, seg_idx int, start double, end double, text string")
    return [(r.para_id, r.start, r.end, r.text, r.seg_indices) for r in timeline.paragraphs(df, **options).orderBy("para_id").collect()]


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([(0, 2, "a"), (3.6, 5, "b")], 2),
        ([(0, 2, "a"), (3.5, 5, "b")], 1),
        ([(0, 1, "Hi."), (1.9, 2, "x")], 2),
        ([(0, 1, "Hi"), (1.9, 2, "x")], 1),
        ([(0, 10, "a"), (10, 30, "b")], 1),
        ([(0, 10, "a"), (10, 30.5, "b")], 2),
        ([(0, 1, " "), (2, 3, "　")], 0),
    ],
)
def test_paragraph_rules(spark, rows, n):
    assert len(paras(spark, rows)) == n


def test_blank_first_segment_opens_the_paragraph(spark):
    assert paras(spark, [(0, 1, " "), (5, 6, "a")]) == [("p0000", 0.0, 6.0, "a", [1])]


def restated(rows, gap=1.5, soft=0.8, most=30.0):
    import re

    out, cur, begin, end = [], [], rows[0][0] if rows else 0, None
    for i, (s, e, t) in enumerate(rows):
        t = t.strip()
        if not t:
            continue
        if cur and (s - end > gap or (s - end > soft and re.search(r"[.!?。！？…]+\s*$", cur[-1][1])) or e - begin > most):
            out.append((begin, end, cur))
            cur, begin = [], s
        cur.append((i, t))
        end = e
    if cur:
        out.append((begin, end, cur))
    return [(f"p{k:04d}", b, e, " ".join(t for _, t in c), [i for i, _ in c]) for k, (b, e, c) in enumerate(out)]


@pytest.mark.parametrize("seed", range(4))
def test_paragraphs_equal_a_restatement(spark, seed):
    r = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(120):
        t += r.choice([0, 0, 0, 0.5, 1, 2])
        e = t + r.choice([1, 3, 8, 31])
        rows.append((t, e, r.choice(["a", "b.", " ", "c?", "d ", "e。"])))
        t = e
    assert paras(spark, rows) == restated(rows)


def test_window_budget_stops_before_the_line_that_exceeds(spark):
    df = spark.createDataFrame([("v", "p0", 0.0, 1.0, "abcd"), ("v", "p1", 1.0, 2.0, "efghij")], "video_id string, para_id string, start double, end double, text string")
    assert timeline.transcript_window(df, "video_id", 0.0, 5.0, 25).first().window_text == "[00:00:00] abcd"


def test_sections_are_half_open(spark):
    f = spark.createDataFrame([("v", i, t) for i, t in enumerate([0.0, 9.99, 10.0, 20.0])], "video_id string, frame_idx int, timestamp double")
    s = spark.createDataFrame([("v", "s1", 0.0, 10.0), ("v", "s2", 10.0, 20.0), ("v", "s3", 30.0, 40.0)], "video_id string, id string, start double, end double")
    got = {r.id: r.frame_ids for r in ranges.assign_to_sections(f, s, "video_id", "id", "timestamp", "frame_idx").collect()}
    assert got == {"s1": [0, 1], "s2": [2], "s3": []}


def test_nearest_tie_goes_to_the_first_inserted(spark):
    left = spark.createDataFrame([("v", 2.0), ("w", 2.0)], "video_id string, at double")
    right = spark.createDataFrame([("v", 3.0, 0, "c"), ("v", 1.0, 1, "a")], "video_id string, t double, o int, name string")
    got = {r.video_id: r.nearest for r in ranges.nearest(left, right, "video_id", "at", "t", "o", "name").collect()}
    assert got == {"v": "c", "w": None}


def test_scores_of_three_frames(spark):
    rows = [("v", i, h) for i, h in enumerate(["0" * 16, "", "0" * 14 + "3f"])]
    df = spark.createDataFrame(rows, "video_id string, i int, phash string").withColumn("phash_bits", scalars.hash_bits(F.col("phash")))
    got = scoring.stability(scoring.novelty(df, "video_id", ["i"]), "video_id", ["i"]).orderBy("i").collect()
    assert [r.novelty_score for r in got] == [10.0, 5.0, 0.9375] and [r.stability_score for r in got] == [2.5, 2.5, 2.5]


def test_top_bit_of_a_hash(spark):
    assert spark.range(1).select(scalars.hash_bits(F.lit("f" * 16)).alias("h")).first().h == -1


def test_anchor_bands(spark):
    f = spark.createDataFrame([("v", t) for t in (8.1, 8.0, 5.0)], "video_id string, timestamp double")
    a = spark.createDataFrame([("v", 10.0)], "video_id string, timestamp double")
    got = ranges.band_distance(f, a, "video_id", "timestamp", "timestamp", 5.0).select("timestamp", ranges.anchor_score(F.col("anchor_distance")).alias("s")).collect()
    assert {r.timestamp: r.s for r in got} == {8.1: 10.0, 8.0: 5.0, 5.0: 0.0}


def test_leaders_and_caps(spark):
    df = spark.createDataFrame([("v", i, h) for i, h in enumerate([0x0, 0x1F, 0x3F, 0x7])], "k string, i int, h long")
    assert [r.i for r in select.leader_dedup(df, "k", ["i"], "h", 5).orderBy("i").collect()] == [0, 2]
    ten = spark.createDataFrame([("v", i) for i in range(10)], "k string, i int")
    assert [r.i for r in select.uniform_cap(ten, "k", ["i"], 4).orderBy("i").collect()] == [0, 2, 5, 7]


def spaced(rows, cap, gap, n=6):
    rows = sorted(rows)
    lo, hi = rows[0][0], rows[-1][0]
    hi = hi if hi > lo else lo + 1
    buckets = [[] for _ in range(n)]
    for t, s in rows:
        buckets[min(int((t - lo) / ((hi - lo) / n)), n - 1)].append((t, s))
    taken = []
    for b in buckets:
        k = 0
        for t, _ in sorted(b, key=lambda x: -x[1]):
            if k < max(cap // n, 1) and all(abs(t - u) >= gap for u in taken):
                taken.append(t)
                k += 1
    for t, _ in sorted(rows, key=lambda x: -x[1]):
        if len(taken) < cap and all(abs(t - u) >= gap for u in taken):
            taken.append(t)
    return sorted(taken)


@pytest.mark.parametrize("seed", range(3))
def test_spaced_choice_equals_a_restatement(spark, seed):
    r = random.Random(seed)
    rows = [(float(t), r.randrange(20) / 2) for t in r.sample(range(400), 60)]
    df = spark.createDataFrame([("v", t, s, i) for i, (t, s) in enumerate(rows)], "k string, t double, s double, i int")
    got = sorted(x.t for x in select.spaced_top_k(df, "k", "t", "s", "i", 12, 9.0).collect())
    assert got == spaced(rows, 12, 9.0)


def test_spaced_choice_may_exceed_a_small_cap(spark):
    df = spark.createDataFrame([("v", float(t), 1.0, t) for t in range(0, 60, 10)], "k string, t double, s double, i int")
    assert select.spaced_top_k(df, "k", "t", "s", "i", 3, 3.0).count() == 6
    assert select.spaced_top_k(df, "k", "t", "s", "i", 3, 3.0, strict_cap=True).count() == 3


def test_caption_fraction_counts_as_thousandths(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.5 --> 00:00:02.000\nhello <b>x</b>\nthere\n\n00:01.0 --> 00:02.0\nno hours"
    got = text.parse_captions(spark.createDataFrame([("v", vtt)], "video_id string, value string")).collect()
    assert [(r.start, r.end, r.text) for r in got] == [(1.005, 2.0, "1 hello <b>x</b> there")]


def test_stamps_are_kept_within_five_seconds(spark):
    md = "[00:00:05] [00:00:04] [00:00:17] [00:00:18] [12:00]"
    secs = spark.createDataFrame([("v", 1, md), ("w", 1, md)], "video_id string, id int, md string")
    segs = spark.createDataFrame([("v", 10.0, 12.0)], "video_id string, start double, end double")
    got = {r.video_id: r for r in text.repair_stamps(secs, segs, "video_id", "id", "md").collect()}
    assert got["v"].repaired == "[00:00:05] [00:00:10] [00:00:17] [00:00:10] [12:00]" and len(got["v"].changes) == 2
    assert got["w"].repaired == md and got["w"].changes == []


def test_fences_with_odd_info_strings_mispair(spark):
    md = "```c++\nint x = compute();\n```\nprose between the fences\n```python\nvalue = 1 + 2 + 3\n```\n"
    got = spark.range(1).select(text.code_blocks(F.lit(md)).alias("b")).first().b
    assert [b.code for b in got] == ["prose between the fences"]


def test_image_lines(spark):
    md = "![a](x/ok.jpg) and ![b](x/no.jpg)\n![c](x/no.jpg)\nend"
    kept, names = text.drop_foreign_images(F.lit(md), F.array(F.lit("ok.jpg")))
    got = spark.range(1).select(kept.alias("k"), names.alias("n")).first()
    assert got.k == "![a](x/ok.jpg) and ![b](x/no.jpg)\nend" and got.n == ["no.jpg"]


@pytest.mark.parametrize(("code", "want"), [("x = 1", True), ("# a long comment\n// more", True), ("foo(a, ...)  # long enough", True), ("foo(a, b)  # long enough", False)])
def test_placeholders(spark, code, want):
    assert spark.range(1).select(scalars.is_placeholder(F.lit(code)).alias("p")).first().p is want


def test_unknown_model_and_stage(spark):
    calls = spark.createDataFrame([("nope", 1000, 1000)], "model string, i long, o long")
    assert ledger.chat_cost(calls, ledger.price_table(spark), "i", "o").first().cost_usd == 0.004
    rows = spark.createDataFrame([(1, 1, "s", 0.5, 0.625), (1, 2, "s", 0.375, 0.0), (1, 3, "s", 0.5, 0.0), (1, 4, "s", 0.0, 0.0), (2, 1, "other", 0.0, 0.0)], "run_id int, call_pos int, stage string, estimate double, actual double")
    limits = spark.createDataFrame([("s", 1.0, 9)], "stage string, money_limit double, call_limit int")
    got = {(r.run_id, r.call_pos): r.verdict for r in ledger.admit_until_reject(rows, limits, 9.0).collect()}
    assert got == {(1, 1): "admitted", (1, 2): "admitted", (1, 3): "stage_money", (1, 4): "stopped", (2, 1): "calls"}


def test_chat_falls_back_to_reasoning_and_caches(spark):
    class Odd(models.FakeProvider):
        def complete(self, model, prompts, max_tokens, temperature):
            return [(" ", "why " + p) for p in prompts]

    calls = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "a")], "model string, prompt string")
    assert {r.reply for r in models.chat(calls, Odd).collect()} == {"why a", "why b"}
    cache = spark.createDataFrame([], "input_key string, reply string")
    first, new = models.cached_chat(calls, cache, Odd)
    assert first.count() == 3 and new.count() == 2
    again, none = models.cached_chat(calls, new, Odd)
    assert none.count() == 0 and again.where("reply is null").count() == 0


def test_plans_push_filters_and_columns(spark, small):
    from timeloom.plans.catalog import QUERIES

    plan = QUERIES["x_pricing_summary"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_orderkey" not in plan
    assert "CartesianProduct" not in QUERIES["j2_range_join"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_picture_hash_equals_a_plain_transform(spark):
    import numpy as np

    from timeloom.operators import models

    rng = np.random.default_rng(1)
    for shape in ((32, 32), (64, 96)):
        grey = rng.random(shape)
        small = grey.reshape(32, shape[0] // 32, 32, shape[1] // 32).mean(axis=(1, 3))
        low = np.array([[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
        want = sum(1 << k for k in range(64) if low[k] > np.median(low))
        assert models.perceptual_hash(grey) % (1 << 64) == want
    files = spark.createDataFrame([("a", bytes(range(256)) * 4), ("b", None), ("c", b"short")], "path string, content binary")
    decode = lambda b: np.frombuffer(b, np.uint8).astype(float).reshape(32, 32) if len(b) == 1024 else None
    got = {r.path: r.phash_bits for r in models.hash_pictures(files, decode).collect()}
    assert got["b"] is None and got["c"] is None and got["a"] is not None


def test_near_vectors_and_odd_ones(spark):
    from timeloom.operators import vectors

    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0]), (7, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    assert sorted((r.a, r.b) for r in vectors.near_vectors(df, "i", "v").collect()) == [(1, 2), (1, 7), (2, 7)]
    assert vectors.near_vectors(df.limit(0), "i", "v").count() == 0
    # More rows of one query id than a block holds, in slices.
    queries = spark.createDataFrame([(9, [1.0, 0.0])] * 7, "q long, v array<double>")
    best = vectors.cosine_top_k(df.where("i in (1, 3, 6)"), queries, "i", "q", "v", k=2, max_queries=3).collect()
    assert sorted((r.i, r.rank) for r in best) == [(1, 1), (3, 2)]
    assert vectors.cosine_top_k(df, queries.limit(0), "i", "q", "v").count() == 0


def test_pairs_and_leaders_equal_brute_force(spark):
    import random

    from timeloom.operators import select

    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(20)]
    codes = [s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 20))) for s in seeds for _ in range(12)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(i % 2, i, c) for i, c in enumerate(signed)] + [(0, 999, None)], "k long, i long, h long")
    for threshold in (3, 5, 14):
        want = {(a, b) for b in range(len(codes)) for a in range(b) if a % 2 == b % 2 and bin(codes[a] ^ codes[b]).count("1") <= threshold}
        got = select.hamming_pairs(df, "k", "i", "h", threshold).collect()
        assert len(got) == len(want) and {(x.a, x.b) for x in got} == want
        kept: dict[int, list[int]] = {0: [], 1: []}
        for i, c in enumerate(codes):
            if all(bin(c ^ codes[j]).count("1") > threshold for j in kept[i % 2]):
                kept[i % 2].append(i)
        assert sorted(x.i for x in select.leader_dedup(df, "k", ["i"], "h", threshold).collect()) == sorted(kept[0] + kept[1])


def test_range_join_of_long_and_short_intervals(spark):
    """From no length to without end; a ten-hour interval makes two rows."""
    import random

    from timeloom.operators import ranges

    r = random.Random(7)
    spans = [(k % 3, k, a := r.uniform(-500, 500), a + r.choice([0.0, 1e-7, 0.01, 1.0, 33.0, 4096.0, 36_000.0])) for k in range(60)] + [(0, 100, 5.0, float("inf")), (0, 101, 9.0, 8.0), (1, 102, None, 4.0), (None, 103, 0.0, 1e9)]
    points = [(k % 4, k, r.choice([r.uniform(-600, 40_000), spans[k % 60][2], spans[k % 60][3]])) for k in range(300)] + [(0, 900, None), (None, 901, 1.0)]
    p, i = spark.createDataFrame(points, "k long, p long, at double"), spark.createDataFrame(spans, "k long, i long, s double, e double")
    for closed in (False, True):
        want = sorted((b, j) for ka, b, at in points for kb, j, s, e in spans if ka is not None and ka == kb and at is not None and s is not None and s <= at and (at <= e if closed else at < e))
        assert sorted((x.p, x.i) for x in ranges.range_join(p, i, "k", "at", "s", "e", closed_end=closed).collect()) == want
    left = [(x.p, x.i) for x in ranges.range_join(p, i, "k", "at", "s", "e", how="left", closed_end=True).collect()]
    assert sorted(x for x in left if x[1] is not None) == want and {x for x, y in left if y is None} == {b for _, b, _ in points} - {b for b, _ in want}
    assert "Generate explode(array_distinct" in ranges.range_join(p, i, "k", "at", "s", "e")._jdf.queryExecution().optimizedPlan().toString()


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    """Families of like vectors, several blocks and chunks, and how few products are computed."""
    import numpy as np

    from timeloom.operators import vectors

    monkeypatch.setattr(vectors, "CHUNK", 100)
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 150)
    r = np.random.default_rng(1)
    m = np.repeat(r.normal(size=(150, 24)), 6, axis=0) + r.normal(scale=0.12, size=(900, 24))
    m[0] = 0
    df = spark.createDataFrame([(f"v{k:04d}", v.tolist()) for k, v in enumerate(m)] + [("none", None), ("v0001", m[1].tolist())], "i string, v array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]
    s = u @ u.T
    want = {(f"v{a:04d}", f"v{b:04d}") for a, b in np.argwhere(np.triu(s > 0.95, 1))}
    got = [(x.a, x.b) for x in vectors.near_vectors(df, "i", "v").collect()]
    assert len(want) > 500 and set(got) == want and len(got) == len(want) + sum("v0001" in w for w in want)
    work = vectors.near_vector_work(df, "i", "v").groupBy().sum().first()
    assert work[1] < 0.05 * 900 * 899 / 2 and work[0] <= 900 * 901 / 2 + 900


def test_near_vectors_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    """Vectors without a direction that stands out reach all chunks; each row goes to as many groups as there are shelves at most."""
    import numpy as np

    from timeloom.operators import vectors

    for name, value in {"CHUNK": 20, "ROWS_A_PIVOT": 40, "SHELVES": 4}.items():
        monkeypatch.setattr(vectors, name, value)
    m = np.random.default_rng(8).normal(size=(600, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "i long, v array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = {(a, b) for a, b in np.argwhere(np.triu(u @ u.T > 0.8, 1)).tolist()}
    got = [(x.a, x.b) for x in vectors.near_vectors(df, "i", "v", 0.8).collect()]
    assert set(got) == want and len(got) == len(want)
    grouped = vectors._meetings(df, "i", "v", 0.8)[0]
    times = grouped.count().collect()
    assert sum(r["count"] for r in times) <= 4 * 600 and len(times) <= 10


def test_near_vectors_of_the_table(spark):
    from timeloom.operators import vectors
    from timeloom.session import load

    e = load(spark, "/root/testdata/sf0.1", "embeddings")
    met, computed = vectors.near_vector_work(e, "vec_id", "embedding").groupBy().sum().first()
    n = e.count()
    assert computed < 0.05 * n * (n - 1) / 2


def test_cosine_search_by_blocks_and_chunks(spark):
    import numpy as np

    from timeloom.operators import vectors

    r = np.random.default_rng(3)
    m = r.normal(size=(300, 8))
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "i long, v array<double>")
    queries = items.where("i % 4 = 0").select(items.i.alias("q"), "v")
    a = vectors.cosine_top_k(items, queries, "i", "q", "v", k=5)
    b = vectors.cosine_top_k(items, queries, "i", "q", "v", k=5, max_queries=20, max_items=40)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 75 * 5


def test_leaders_of_null_keys_copies_and_one_key_in_many_tasks(spark):
    from timeloom.operators import select

    df = spark.createDataFrame([(None, 1, 0, "x"), (None, 2, 0, "y"), (None, 3, 1, "z"), ("a", 4, 0, "w"), ("a", 5, 255, "v"), ("a", 0, 255, "u"), ("a", 6, None, "t")], "k string, o long, h long, note string")
    assert sorted((r.o, r.note) for r in select.leader_dedup(df, "k", ["o"], "h", 3).collect()) == [(0, "u"), (1, "x"), (4, "w")]
    assert select.leader_dedup(df.limit(0), "k", ["o"], "h", 3).count() == 0
    many = spark.range(4000).selectExpr("1 AS k", "id AS o", "xxhash64(id) AS h")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = select.leader_dedup(many.repartition(8), "k", ["o"], "h", 5)
        assert sum(n > 500 for n in kept.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1 and kept.count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("block", "round_"), [(16_384, 131_072), (40, 60), (1, 1)])
def test_leaders_of_wide_thresholds_go_block_by_block(spark, monkeypatch, block, round_):
    """Beyond 14 bits; short keys, keys of several blocks, a null key and copies. No pairs are joined."""
    monkeypatch.setattr(select, "LEADER_BLOCK", block)
    monkeypatch.setattr(select, "LEADER_ROUND", round_)
    monkeypatch.setattr(select, "hamming_pairs", None)
    r = random.Random(block)
    sizes = {"a": 3, "b": 90, "c": 60, None: 12} if block > 1 else {"a": 2, "b": 7, None: 1}
    rows = [(k, f"{i:03d}", r.getrandbits(64) - (1 << 63)) for k, n in sizes.items() for i in range(n)]
    rows += [(k, "z" + o, h) for k, o, h in rows[::9]] + [("b", "000", None)]
    r.shuffle(rows)
    want = []
    for key in sizes:
        kept: list[int] = []
        for _, o, h in sorted((x for x in rows if x[0] == key and x[2] is not None), key=lambda x: x[1:]):
            if all(((h ^ c) & (1 << 64) - 1).bit_count() > 26 for c in kept):
                kept.append(h)
                want.append((key, o, h))
    got = select.leader_dedup(spark.createDataFrame(rows, "k string, o string, h long"), "k", ["o"], "h", 26).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_npy_files_are_read_by_ranges(spark, tmp_path):
    import numpy as np
    import pytest

    from timeloom.sources import npy

    r = np.random.default_rng(0)
    m = r.normal(size=(1000, 6)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(9999, None)], "i long, v array<float>")
    written = npy.write_npy(rows.repartition(3), "v", f"{tmp_path}/v").collect()
    assert sum(w.n for w in written) == 1000
    got = npy.read_npy(spark, f"{tmp_path}/v", rows=90)
    assert got.rdd.getNumPartitions() >= 12
    assert sorted(tuple(x.vector) for x in got.collect()) == sorted(map(tuple, m.tolist()))
    np.save(tmp_path / "d.npy", np.arange(12.0).reshape(4, 3))
    assert [(x.row, x.vector) for x in npy.read_npy(spark, f"{tmp_path}/d.npy", rows=2).orderBy("row").collect()] == [(k, [3.0 * k, 3 * k + 1, 3 * k + 2]) for k in range(4)]
    (tmp_path / "empty").mkdir()
    assert npy.read_npy(spark, f"{tmp_path}/empty").count() == 0
    np.save(tmp_path / "odd.npy", np.arange(3))
    with pytest.raises(Exception, match="no table of numbers"):
        npy.read_npy(spark, f"{tmp_path}/odd.npy").count()


def test_search_reads_only_parts_with_hits(spark, tmp_path):
    from pyspark.sql import functions as F

    from timeloom.operators import search

    rows = [(k, f"text number {k} " + ("with a Zebra in it" if k in (7, 40) else "zeb bra ebr" if k == 5 else "zeb bra")) for k in range(60)] + [(60, None), (61, ""), (62, "ab"), (63, "ÄÖÜ straße")]
    df = spark.createDataFrame(rows, "k long, t string")
    index = search.build_index(df, "k", "t", f"{tmp_path}/index", parts=16)
    for word in ("zebra", "ZEBRA IN", "ab", "öü S", "nothing", "a", "text number 3"):
        want = sorted(k for k, t in rows if t is not None and word.lower() in t.lower())
        assert sorted(r.k for r in search.search(spark, index, word).collect()) == want, word
    hits = search.search(spark, index, "zebra")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    parts = {r.p for r in df.where("k in (5, 7, 40)").select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("p")).collect()}
    assert {int(x) for m in re.findall(r"PartitionFilters: \[[^\]]*_part#\d+ IN(?:SET)? \(?([\d, ]+)", plan) for x in m.split(",")} == parts


@pytest.mark.parametrize("depth", [2, 64])
def test_spaced_choice_from_the_best_of_each_bucket(spark, depth):
    """The fold over all rows in plain Python; with two rows of a bucket at first, most keys are folded again."""
    r = random.Random(5)
    rows = [(k, r.choice([r.uniform(0, 100), float(r.randrange(100))]), r.choice([r.random(), 0.5, None]), i) for i, k in enumerate(r.choice([1, 1, 1, 2, 3]) for _ in range(900))]
    rows = list({(k, t): (k, t, s, i) for k, t, s, i in rows}.values()) + [(4, 1.0, 0.5, 9000), (5, 2.0, None, 9001)]
    df = spark.createDataFrame(rows, "k long, t double, s double, i long")

    def plain(own, cap, gap, strict):
        lo, hi = min(x[1] for x in own), max(x[1] for x in own)
        width = ((hi if hi > lo else lo + 1) - lo) / 6
        order = sorted(own, key=lambda x: (x[2] is None, -(x[2] or 0), x[1], x[3]))
        chosen = []
        for b in range(6):
            n = 0
            for x in order:
                if min(math.floor((x[1] - lo) / width), 5) == b and n < max(cap // 6, 1) and all(abs(x[1] - c) >= gap for c in chosen) and not (strict and len(chosen) >= cap):
                    chosen.append(x[1])
                    n += 1
        for x in order:
            if len(chosen) < cap and all(abs(x[1] - c) >= gap for c in chosen):
                chosen.append(x[1])
        return chosen

    for cap, gap, strict in ((12, 3.0, False), (40, 1.5, False), (4, 20.0, True), (3, 0.0, True)):
        want = sorted((k, t) for k in {x[0] for x in rows} for t in plain([x for x in rows if x[0] == k], cap, gap, strict))
        got = select.spaced_top_k(df, "k", "t", "s", "i", cap, gap, strict_cap=strict, depth=depth)
        assert sorted((x.k, x.t) for x in got.collect()) == want, (cap, gap)


def test_running_tail_is_bounded(spark):
    from timeloom.operators import timeline

    texts = ["ab", "", "cdef", "g" * 30, "h", "", "ij"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k long, o long, t string")
    got = {r.o: r.written_tail for r in timeline.running_tail(df, "k", "o", "t", 8).collect()}
    assert got == {i: "\n".join(texts[:i])[-8:] for i in range(len(texts))}


def test_running_tail_may_begin_with_a_line_break(spark):
    texts = ["ab", "cdefghi", "jk", "", "lmno", "p"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k long, o long, t string")
    for n in (1, 3, 7, 8):
        got = {r.o: r.written_tail for r in timeline.running_tail(df, "k", "o", "t", n).collect()}
        assert got == {i: "\n".join(texts[:i])[-n:] for i in range(len(texts))}, n


def test_small_helpers(spark, tmp_path):
    from pyspark.sql import functions as F

    from timeloom.functions.scalars import render
    from timeloom.sources import readers

    assert spark.range(1).select(render("{{{a}}} {b}", a=F.lit(1), b=F.lit(None)).alias("x")).first().x == "{1} "
    listing = spark.createDataFrame([("a",), ("a",)], "path string")
    assert [r.path for r in readers.existing(spark.createDataFrame([("a",), ("b",)], "path string"), listing).collect()] == ["a"]
    long = "money:\n" + "".join(f"  s{i}: {i}\n" for i in range(1500))
    (tmp_path / "c.yaml").write_text(long)
    assert readers.read_limits(spark, str(tmp_path / "c.yaml"), 1.0).count() == 1500
