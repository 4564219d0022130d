"""Queries over timelines: sessions, paragraphs, ranges, scores and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import ranges, scoring, search, select, timeline, vectors
from timeloom.plans.inputs import FRAMES, SECTIONS, SEGMENTS, STRIP, frames, hms_sql, sections, segments
from timeloom.session import load
from timeloom.storage import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query("""
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS session_start, max(ts) AS session_end
FROM (SELECT user_id, ts, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
GROUP BY user_id, session""")
def w1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sessions_by_time(load(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600)


_PARAS = f"""WITH RECURSIVE {SEGMENTS},
kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM
  (SELECT video_id, seg_idx, "start", "end", {STRIP.format("text")} AS text, first_value("start") OVER (PARTITION BY video_id ORDER BY seg_idx) AS seed FROM segments) WHERE text <> ''),
fold AS (
  SELECT video_id, k, seg_idx, "start", "end", text, seed AS begins, 0 AS para FROM kept WHERE k = 1
  UNION ALL
  SELECT video_id, k, seg_idx, "start", "end", text, CASE WHEN cut THEN "start" ELSE begins END, para + CASE WHEN cut THEN 1 ELSE 0 END
  FROM (SELECT n.*, f.begins, f.para,
      (n."start" - f."end" > 1.5) OR (n."start" - f."end" > 0.8 AND regexp_matches(f.text, '[.!?。！？…]+\\s*$')) OR (n."end" - f.begins > 30.0) AS cut
    FROM fold f JOIN kept n ON n.video_id = f.video_id AND n.k = f.k + 1)),
paras AS (SELECT video_id, printf('p%04d', para) AS para_id, first(begins ORDER BY k) AS "start", last("end" ORDER BY k) AS "end",
  string_agg(text, ' ' ORDER BY k) AS text, list(seg_idx ORDER BY k) AS seg_indices FROM fold GROUP BY video_id, para)
"""


@_query(_PARAS + 'SELECT video_id, para_id, "start", "end", text, seg_indices FROM paras')
def w1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return timeline.paragraphs(segments(spark, d))


@_query(_PARAS + f""", lines AS (SELECT video_id, para_id, '[' || {hms_sql('"start"')} || '] ' || text AS line FROM paras WHERE "end" > 20 AND "start" < 200),
used AS (SELECT *, sum(length(line)) OVER (PARTITION BY video_id ORDER BY para_id) AS u FROM lines)
SELECT video_id, string_agg(line, chr(10) ORDER BY para_id) AS window_text FROM used WHERE u <= 3000 GROUP BY video_id""")
def f3_w6_window_budget(spark: SparkSession, d: str) -> DataFrame:
    return timeline.transcript_window(timeline.paragraphs(segments(spark, d)), "video_id", 20.0, 200.0, 3000)


@_query(_PARAS + """SELECT video_id, para_id, "start", "end", left(text, 200) AS text FROM (
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY para_id) AS r FROM paras WHERE contains(lower(text), 'the')) WHERE r <= 10""")
def f2_search(spark: SparkSession, d: str) -> DataFrame:
    from timeloom.functions.scalars import contains_keyword

    hits = timeline.paragraphs(segments(spark, d)).where(contains_keyword(F.col("text"), "THE"))
    return select.first_n(hits, ["video_id"], ["para_id"], 10).select("video_id", "para_id", "start", "end", F.left("text", F.lit(200)).alias("text"))


@_query(ORACLES["f2_search"])
def f2_indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same hits, from an index of letter triples that is built first."""
    index = search.build_index(timeline.paragraphs(segments(spark, d)), "video_id", "text", shared_dir(spark))
    hits = search.search(spark, index, "THE")
    return select.first_n(hits, ["video_id"], ["para_id"], 10).select("video_id", "para_id", "start", "end", F.left("text", F.lit(200)).alias("text"))


@_query(f"""WITH {SEGMENTS} SELECT video_id, string_agg('[' || {hms_sql('"start"')} || '] ' || text, chr(10) ORDER BY seg_idx) AS transcript FROM segments GROUP BY video_id""")
def r4_transcript(spark: SparkSession, d: str) -> DataFrame:
    return timeline.format_transcript(segments(spark, d))


@_query(f"""WITH {SECTIONS} SELECT video_id, section_id, CAST(i AS INTEGER) AS frame_idx, "start" + (i + 0.5::DOUBLE) / 0.001::DOUBLE AS "timestamp"
FROM sections, range(0, 21) r(i)""")
def r1_clock(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sample_clock(sections(spark, d), 0.001).select("video_id", "section_id", "frame_idx", "timestamp")


@_query(f"""WITH {FRAMES} SELECT video_id, event_id, printf('f%04d', frame_idx) AS frame_id FROM frames""")
def r2_ids(spark: SparkSession, d: str) -> DataFrame:
    return timeline.mint_ids(frames(spark, d), "f", ["video_id"], ["frame_idx"], "frame_id").select("video_id", "event_id", "frame_id")


@_query(f"""WITH {FRAMES} SELECT event_id, {hms_sql('"timestamp"')} AS label FROM frames""")
def r3_fmt(spark: SparkSession, d: str) -> DataFrame:
    from timeloom.functions.scalars import hms

    return frames(spark, d).select("event_id", hms(F.col("timestamp")).alias("label"))


@_query(f"""WITH {SEGMENTS} SELECT video_id, seg_idx, "start" FROM segments WHERE "start" < 120""")
def r12_truncate(spark: SparkSession, d: str) -> DataFrame:
    return timeline.truncated(segments(spark, d), 120.0).select("video_id", "seg_idx", "start")


_TIMELINE = f"""WITH {SEGMENTS}, {FRAMES}, both_ AS (
SELECT video_id, "start" AS ts, 0 AS rk, 'speech' AS kind, seg_idx AS idx, text AS content FROM segments
UNION ALL SELECT video_id, "timestamp" / 5000, 1, 'frame', frame_idx, type FROM frames)
"""


@_query(_TIMELINE + "SELECT video_id, ts, kind, idx, content, row_number() OVER (PARTITION BY video_id ORDER BY ts, rk, idx) AS position FROM both_")
def u1_timeline(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("video_id", (F.col("timestamp") / 5000).alias("timestamp"), "frame_idx", F.col("type").alias("description"))
    return timeline.merged_timeline(segments(spark, d), f)


@_query(f"""WITH {SEGMENTS} SELECT video_id, seg_idx, right(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 200) AS written_tail FROM segments""")
def w8_running_tail(spark: SparkSession, d: str) -> DataFrame:
    return timeline.running_tail(segments(spark, d), "video_id", "seg_idx", "text", 200).select("video_id", "seg_idx", "written_tail")


@_query(f"""WITH {SEGMENTS} SELECT video_id, seg_idx, CAST(floor(coalesce(sum(length(text)) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500.0) AS BIGINT) AS chunk FROM segments""")
def d3_length_chunks(spark: SparkSession, d: str) -> DataFrame:
    return timeline.length_chunks(segments(spark, d), "video_id", "seg_idx", "text", 500).select("video_id", "seg_idx", "chunk")


@_query(f"""WITH {FRAMES}, {SECTIONS} SELECT s.video_id, s.section_id, coalesce(list(f.frame_idx ORDER BY f.frame_idx) FILTER (f.frame_idx IS NOT NULL), []) AS frame_ids
FROM sections s LEFT JOIN frames f ON f.video_id = s.video_id AND f."timestamp" >= s."start" AND f."timestamp" < s."end" GROUP BY s.video_id, s.section_id""")
def j1_range_assign(spark: SparkSession, d: str) -> DataFrame:
    return ranges.assign_to_sections(frames(spark, d), sections(spark, d), "video_id", "section_id", "timestamp", "frame_idx").select("video_id", "section_id", "frame_ids")


@_query(f"""WITH {FRAMES}, {SECTIONS} SELECT f.event_id, s.section_id FROM frames f JOIN sections s ON f.video_id = s.video_id AND f."timestamp" >= s."start" AND f."timestamp" < s."end" """)
def j2_range_join(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d).select("video_id", "section_id", "start", "end")
    return ranges.range_join(frames(spark, d), s, "video_id", "timestamp", "start", "end").select("event_id", "section_id")


@_query(f"""WITH {FRAMES}, {SECTIONS} SELECT event_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE f.video_id = s.video_id AND f."timestamp" >= s."start" AND f."timestamp" < s."end")""")
def d4_skip_windows(spark: SparkSession, d: str) -> DataFrame:
    return ranges.not_in_ranges(frames(spark, d), sections(spark, d), "video_id", "timestamp").select("event_id")


@_query(f"""WITH {FRAMES} SELECT event_id, nearest, distance FROM (
SELECT a.event_id, b.event_id AS nearest, abs(a."timestamp" - b."timestamp") AS distance,
  row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a."timestamp" - b."timestamp"), b.frame_idx) AS r
FROM (SELECT * FROM frames WHERE type = 'view') a LEFT JOIN (SELECT * FROM frames WHERE type = 'error') b ON a.video_id = b.video_id) WHERE r = 1""")
def j3_nearest(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    views = f.where("type = 'view'").select("video_id", "event_id", "timestamp")
    errors = f.where("type = 'error'").select("video_id", "event_id", "timestamp", "frame_idx")
    return ranges.nearest(views, errors, "video_id", "timestamp", "timestamp", "frame_idx", "event_id").select("event_id", "nearest", "distance")


@_query(f"""WITH {FRAMES}, near AS (SELECT a.event_id, min(abs(a."timestamp" - b."timestamp")) / 3600 AS dist
FROM (SELECT * FROM frames WHERE type = 'view') a LEFT JOIN (SELECT * FROM frames WHERE type = 'error') b ON a.video_id = b.video_id GROUP BY a.event_id)
SELECT event_id, CASE WHEN dist < 2 THEN 10.0 WHEN dist < 5 THEN 5.0 ELSE 0.0 END::DOUBLE AS anchor_score FROM near""")
def j4_w4_anchor(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("timestamp", F.col("timestamp") / 3600)
    out = ranges.band_distance(f.where("type = 'view'"), f.where("type = 'error'"), "video_id", "timestamp", "timestamp", 5.0)
    return out.select("event_id", ranges.anchor_score(F.col("anchor_distance")).alias("anchor_score"))


@_query(f"""WITH {FRAMES}, {SEGMENTS} SELECT f.event_id, EXISTS (SELECT 1 FROM segments s WHERE s.video_id = f.video_id AND f."timestamp" / 5000 >= s."start" - 5 AND f."timestamp" / 5000 <= greatest(s."start", s."end") + 5) AS valid FROM frames f""")
def j5_tolerance(spark: SparkSession, d: str) -> DataFrame:
    stamps = frames(spark, d).select("video_id", "event_id", (F.col("timestamp") / 5000).alias("at"))
    return ranges.within_tolerance(stamps, segments(spark, d), "video_id", "at", 5.0).select("event_id", "valid")


_SCORES = f"""WITH {FRAMES}, prev AS (SELECT *, last_value(phash_bits IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_,
 lag(phash_bits) OVER (PARTITION BY video_id ORDER BY frame_idx) AS a, lead(phash_bits) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM frames),
dist AS (SELECT *, bit_count(xor(phash_bits, a)) AS da, bit_count(xor(phash_bits, b)) AS db FROM prev),
scored AS (SELECT video_id, event_id,
 CASE WHEN phash_bits IS NULL THEN 5.0::DOUBLE WHEN before_ IS NULL THEN 10.0::DOUBLE ELSE least(bit_count(xor(phash_bits, before_)) / 6.4::DOUBLE, 10.0::DOUBLE) END AS novelty_score,
 CASE WHEN phash_bits IS NULL OR (da IS NULL AND db IS NULL) THEN 2.5::DOUBLE
   ELSE greatest(0.0::DOUBLE, 5.0::DOUBLE - (CAST(coalesce(da, 0) + coalesce(db, 0) AS DOUBLE) / ((da IS NOT NULL)::INT + (db IS NOT NULL)::INT)) / 3) END AS stability_score,
 CASE WHEN type = 'error' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS anchor_score FROM dist)
"""


@_query(_SCORES + "SELECT event_id, round(novelty_score, 6) AS novelty_score, round(stability_score, 6) AS stability_score, round(novelty_score + anchor_score + stability_score, 6) AS info_score FROM scored")
def w2_w3_w5_scores(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("anchor_score", F.when(F.col("type") == "error", 10.0).otherwise(0.0))
    out = scoring.info_score(scoring.stability(scoring.novelty(f, "video_id", ["frame_idx"]), "video_id", ["frame_idx"]))
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("novelty_score", "stability_score", "info_score")))


@_query(f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
SELECT event_id FROM n WHERE n <= 15 OR frame_idx IN (SELECT CAST(floor(i * (n / 15.0::DOUBLE)) AS INTEGER) FROM range(0, 15) r(i))""")
def k2_uniform_cap(spark: SparkSession, d: str) -> DataFrame:
    return select.uniform_cap(frames(spark, d), "video_id", ["frame_idx"], 15).select("event_id")


@_query(f"""WITH {FRAMES}, e AS (SELECT *, min("timestamp") OVER (PARTITION BY video_id) AS lo, max("timestamp") OVER (PARTITION BY video_id) AS hi FROM frames),
b AS (SELECT *, CAST(least(floor(("timestamp" - lo) / ((CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo) / 6)), 5) AS INTEGER) AS bucket FROM e)
SELECT event_id, bucket, row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, "timestamp", event_id) AS rank_in_bucket FROM b""")
def k4_bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    return select.bucket_rank(frames(spark, d), "video_id", "timestamp", "score", "event_id").select("event_id", "bucket", "rank_in_bucket")


_SPACED = f"""WITH RECURSIVE {FRAMES}, e AS (SELECT *, min("timestamp") OVER (PARTITION BY video_id) AS lo, max("timestamp") OVER (PARTITION BY video_id) AS hi FROM frames),
b AS (SELECT *, CAST(least(floor(("timestamp" - lo) / ((CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo) / 6)), 5) AS INTEGER) AS bucket FROM e),
steps AS (SELECT video_id, "timestamp" AS t, bucket, true AS first_round, row_number() OVER (PARTITION BY video_id ORDER BY bucket, score DESC, "timestamp", event_id) AS k FROM b
  UNION ALL SELECT video_id, "timestamp", bucket, false, count(*) OVER (PARTITION BY video_id) + row_number() OVER (PARTITION BY video_id ORDER BY score DESC, "timestamp", event_id) FROM b),
fold AS (SELECT video_id, 0::BIGINT AS k, []::DOUBLE[] AS times, -1 AS bucket, 0 AS n FROM (SELECT DISTINCT video_id FROM frames)
  UNION ALL SELECT video_id, k, CASE WHEN take THEN list_append(times, t) ELSE times END, bucket, n + take::INT FROM (
    SELECT s.video_id, s.k, s.t, s.bucket, f.times, CASE WHEN f.bucket = s.bucket THEN f.n ELSE 0 END AS n,
      len(list_filter(f.times, lambda x: abs(x - s.t) < 21600)) = 0 AND CASE WHEN s.first_round THEN CASE WHEN f.bucket = s.bucket THEN f.n ELSE 0 END < 2 ELSE len(f.times) < 12 END AS take
    FROM fold f JOIN steps s ON s.video_id = f.video_id AND s.k = f.k + 1)),
chosen AS (SELECT video_id, unnest(arg_max(times, k)) AS t FROM fold GROUP BY video_id)
SELECT video_id, event_id, "timestamp", score FROM (SELECT f.*, row_number() OVER (PARTITION BY f.video_id, "timestamp" ORDER BY score DESC, event_id) AS r
  FROM frames f JOIN chosen c ON c.video_id = f.video_id AND c.t = f."timestamp") WHERE r = 1"""


@_query(_SPACED)
def k4_spaced(spark: SparkSession, d: str) -> DataFrame:
    return select.spaced_top_k(frames(spark, d), "video_id", "timestamp", "score", "event_id", 12, 6 * 3600.0).select("video_id", "event_id", "timestamp", "score")


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.lit(0).alias("grp"), "vec_id", vectors.sign_bits(F.col("embedding")).alias("bits"))


def _with_neighbours(codes: DataFrame) -> DataFrame:
    """The codes, and each once more with three bits turned."""
    turned = F.col("bits").bitwiseXOR(F.call_function("shiftleft", F.lit(7).cast("long"), (F.col("vec_id") % 50).cast("int")))
    return codes.unionAll(codes.select("grp", (F.col("vec_id") + 1_000_000).alias("vec_id"), turned.alias("bits")))


_CODES = """codes AS (SELECT vec_id, CAST(sum(CASE WHEN embedding[i + 1] > 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << i END) ELSE 0 END) AS BIGINT) AS bits
 FROM embeddings, range(0, 64) r(i) GROUP BY vec_id)"""


@_query(f"""WITH RECURSIVE {_CODES}, o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM codes),
fold AS (SELECT 1::BIGINT AS k, [bits] AS kept, true AS keep, vec_id FROM o WHERE k = 1
 UNION ALL SELECT o.k, CASE WHEN ok THEN list_append(kept, o.bits) ELSE kept END, ok, o.vec_id
 FROM (SELECT f.k, f.kept, o.k AS k2, (SELECT min(bit_count(xor(h, o.bits))) FROM unnest(f.kept) u(h)) > 20 AS ok FROM fold f JOIN o ON o.k = f.k + 1) x JOIN o ON o.k = x.k2)
SELECT vec_id FROM fold WHERE keep""")
def d1_leader(spark: SparkSession, d: str) -> DataFrame:
    return select.leader_dedup(_codes(spark, d), "grp", ["vec_id"], "bits", 20).select("vec_id")


@_query(f"""WITH {_CODES}, both_ AS (SELECT * FROM codes UNION ALL SELECT vec_id + 1000000, xor(bits, 7::BIGINT << (vec_id % 50)) FROM codes)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM both_ x JOIN both_ y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) <= 14""")
def j14_hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return select.hamming_pairs(_with_neighbours(_codes(spark, d)), "grp", "vec_id", "bits", 14).select("a", "b", "distance")


_UNIT = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


@_query(f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS query_id, i.vec_id AS vec_id, list_dot_product(q.v, i.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(i.v, i.v)) AS score
 FROM u q, u i WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def k5_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.cosine_top_k(e, q, "vec_id", "query_id", "embedding", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))
