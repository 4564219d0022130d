"""Queries over keyed tables: joins, counts, set operations, the store and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import ledger, models, select, store
from timeloom.plans.inputs import FRAMES, SECTIONS, SEGMENTS, frames, sections, segments
from timeloom.session import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _store(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return f.select(
        "video_id", F.format_string("f%06d", "event_id").alias("frame_id"), "timestamp", "type", (F.col("event_id") % 2 == 0).alias("has_text"),
        F.concat(F.lit("b"), "event_id").alias("brief"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), "event_id")).alias("detail"),
        (F.col("event_id") % 40 / 4.0).alias("info_score"), F.col("event_id"),
    )


_STORE = FRAMES + """, store AS (SELECT video_id, printf('f%06d', event_id) AS frame_id, "timestamp", type, event_id % 2 = 0 AS has_text, 'b' || event_id AS brief,
 CASE WHEN event_id % 3 = 0 THEN 'd' || event_id END AS detail, (event_id % 40) / 4.0::DOUBLE AS info_score, event_id FROM frames)"""


@_query(f"""WITH {_STORE} SELECT video_id, frame_id, "timestamp", type, has_text, brief, detail IS NOT NULL AS has_detail, round_even(info_score, 1) AS info_score FROM store
WHERE type NOT IN ('error', 'view') AND "timestamp" BETWEEN 86400 AND 864000""")
def f5_store(spark: SparkSession, d: str) -> DataFrame:
    return store.list_frames(_store(spark, d), exclude=["error", "view"], time_range=(86400.0, 864000.0))


@_query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def a1_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT u.user_id, t AS event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'view', 'error', 'purchase', 'never']) AS t)
LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t GROUP BY 1, 2""")
def a2_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return store.counts_in_domain(load(spark, d, "events"), "event_type", ["click", "view", "error", "purchase", "never"], ["user_id"])


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Turns as model calls: lengths are tokens, roles are stages."""
    c = load(spark, d, "conversations")
    model = F.element_at(F.array(*(F.lit(m) for m in ("gpt-4o-mini", "gemini-2.5-flash", "glm-4.6", "unknown"))), (F.col("turn") % 4 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("call_pos"), F.col("role").alias("stage"), model.alias("model"), F.length("text").cast("long").alias("n_in"), (F.length("text") % 97).cast("long").alias("n_out"))


_CALLS = """calls AS (SELECT conv_id AS run_id, turn AS call_pos, role AS stage, ['gpt-4o-mini', 'gemini-2.5-flash', 'glm-4.6', 'unknown'][turn % 4 + 1] AS model, length(text) AS n_in, length(text) % 97 AS n_out FROM conversations),
prices AS (SELECT * FROM (VALUES ('gpt-4o-mini', 0.09::DOUBLE, 0.36::DOUBLE), ('gemini-2.5-flash', 0.24::DOUBLE, 2.002::DOUBLE), ('glm-4.6', 1.2::DOUBLE, 4.8::DOUBLE)) t(model, p_in, p_out)),
cost AS (SELECT run_id, call_pos, stage, calls.model, (n_in * coalesce(p_in, 1.0::DOUBLE) + n_out * coalesce(p_out, 3.0::DOUBLE)) * 1.0::DOUBLE / 1e6::DOUBLE AS cost_usd FROM calls LEFT JOIN prices USING (model))"""


@_query(f"WITH {_CALLS} SELECT run_id, call_pos, round(cost_usd, 9) AS cost_usd FROM cost")
def b1_cost(spark: SparkSession, d: str) -> DataFrame:
    return ledger.chat_cost(_calls(spark, d), ledger.price_table(spark), "n_in", "n_out").select("run_id", "call_pos", F.round("cost_usd", 9).alias("cost_usd"))


@_query("SELECT conv_id, turn, round((CASE turn % 4 WHEN 0 THEN 18.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 1.5::DOUBLE END) * 150 * length(text) / 1e6::DOUBLE, 9) AS cost FROM conversations")
def b2_asr_cost(spark: SparkSession, d: str) -> DataFrame:
    model = F.element_at(F.array(*(F.lit(m) for m in ("whisper-1", "gpt-4o-transcribe", "gpt-4o-mini-transcribe", "other"))), (F.col("turn") % 4 + 1).cast("int"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.round(ledger.transcription_cost(model, F.length("text")), 9).alias("cost"))


def _charges(spark: SparkSession, d: str) -> DataFrame:
    """Calls with exact binary money: quarters of the token counts."""
    return _calls(spark, d).select("run_id", "call_pos", "stage", (F.col("n_in") % 64 / 4.0).alias("estimate"), (F.col("n_out") % 32 / 4.0).alias("actual"))


def _limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("user", 40.0, 4), ("assistant", 30.0, 3), ("system", 16.0, 1)], "stage string, money_limit double, call_limit int")


_CHARGES = _CALLS + """, charges AS (SELECT run_id, call_pos, stage, (n_in % 64) / 4.0::DOUBLE AS estimate, (n_out % 32) / 4.0::DOUBLE AS actual,
  CASE stage WHEN 'user' THEN 40.0 WHEN 'assistant' THEN 30.0 WHEN 'system' THEN 16.0 ELSE 0 END AS money_limit, CASE stage WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 WHEN 'system' THEN 1 ELSE 0 END AS call_limit FROM calls)"""


@_query(f"""WITH {_CHARGES}, sums AS (SELECT *, coalesce(sum(actual) OVER (PARTITION BY run_id ORDER BY call_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
 coalesce(sum(actual) OVER s, 0) AS in_stage, count(*) OVER s AS n FROM charges WINDOW s AS (PARTITION BY run_id, stage ORDER BY call_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
why AS (SELECT *, CASE WHEN n >= call_limit THEN 'calls' WHEN in_stage + estimate > money_limit THEN 'stage_money' WHEN spent + estimate > 60 THEN 'total_money' END AS why FROM sums)
SELECT run_id, call_pos, CASE WHEN coalesce(bool_or(why IS NOT NULL) OVER (PARTITION BY run_id ORDER BY call_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'stopped' ELSE coalesce(why, 'admitted') END AS verdict FROM why""")
def b3_admission(spark: SparkSession, d: str) -> DataFrame:
    return ledger.admit_until_reject(_charges(spark, d), _limits(spark), 60.0).select("run_id", "call_pos", "verdict")


@_query(f"""WITH RECURSIVE {_CHARGES}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY call_pos) AS k FROM charges),
f AS (SELECT run_id, 0::BIGINT AS k, 0.0::DOUBLE AS spent, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS ma, 0.0::DOUBLE AS ms, 0 AS nu, 0 AS na, 0 AS ns, NULL::BIGINT AS call_pos, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT run_id FROM o)
UNION ALL SELECT run_id, k, spent + CASE WHEN ok THEN actual ELSE 0 END, mu + CASE WHEN ok AND stage = 'user' THEN actual ELSE 0 END, ma + CASE WHEN ok AND stage = 'assistant' THEN actual ELSE 0 END, ms + CASE WHEN ok AND stage = 'system' THEN actual ELSE 0 END,
 nu + CASE WHEN ok AND stage = 'user' THEN 1 ELSE 0 END, na + CASE WHEN ok AND stage = 'assistant' THEN 1 ELSE 0 END, ns + CASE WHEN ok AND stage = 'system' THEN 1 ELSE 0 END, call_pos, verdict
 FROM (SELECT *, verdict = 'admitted' AS ok FROM (SELECT o.run_id, o.k, f.spent, f.mu, f.ma, f.ms, f.nu, f.na, f.ns, o.call_pos, o.stage, o.actual,
  CASE WHEN CASE o.stage WHEN 'user' THEN nu WHEN 'assistant' THEN na ELSE ns END >= o.call_limit THEN 'calls' WHEN CASE o.stage WHEN 'user' THEN mu WHEN 'assistant' THEN ma ELSE ms END + o.estimate > o.money_limit THEN 'stage_money' WHEN spent + o.estimate > 60 THEN 'total_money' ELSE 'admitted' END AS verdict
  FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1)))
SELECT run_id, call_pos, verdict FROM f WHERE k > 0""")
def b3_admission_each(spark: SparkSession, d: str) -> DataFrame:
    return ledger.admit_each(_charges(spark, d), _limits(spark), 60.0).select("run_id", "call_pos", "verdict")


@_query(f"""WITH {_CHARGES} SELECT run_id, coalesce(stage, '(total)') AS stage, sum(actual) AS spent, count(*) AS calls FROM charges GROUP BY ROLLUP (run_id, stage) HAVING run_id IS NOT NULL""")
def b5_a3_report(spark: SparkSession, d: str) -> DataFrame:
    return ledger.report(_charges(spark, d))


@_query("SELECT conv_id, turn, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) + turn % 3 * 800 AS tokens FROM conversations")
def b6_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", ledger.message_tokens(F.col("text"), F.col("turn") % 3).alias("tokens"))


@_query("SELECT c_custkey, round(c_acctbal / 7.2::DOUBLE, 6) AS usd FROM customer")
def b7_currency(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", F.round(ledger.to_usd(F.col("c_acctbal")), 6).alias("usd"))


@_query(f"""WITH {FRAMES}, {SECTIONS} SELECT s.video_id, s.section_id FROM sections s ANTI JOIN (SELECT DISTINCT video_id, 's' || CAST(floor("timestamp" / 21600) AS INTEGER) AS section_id FROM frames) w USING (video_id, section_id)""")
def j11_u2_missing(spark: SparkSession, d: str) -> DataFrame:
    w = frames(spark, d).select("video_id", F.format_string("s%d", F.floor(F.col("timestamp") / 21600)).alias("section_id"))
    return store.missing(sections(spark, d).select("video_id", "section_id"), w, ["video_id", "section_id"])


@_query(f"""WITH {FRAMES}, {SEGMENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM frames), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS p FROM segments)
SELECT a.video_id, a.p AS position, a.event_id, b.seg_idx FROM a JOIN b USING (video_id, p)""")
def j6_positional(spark: SparkSession, d: str) -> DataFrame:
    out = store.zipped(frames(spark, d), segments(spark, d).select("video_id", "seg_idx"), "video_id", "frame_idx", "seg_idx")
    return out.select("video_id", "position", "event_id", "seg_idx")


@_query("""WITH f AS (SELECT label AS video_id, 'v' || vec_id AS frame_id FROM embeddings), v AS (SELECT label AS video_id, 'v' || vec_id AS frame_id, len(embedding) AS dim FROM embeddings WHERE label % 2 = 0 OR vec_id % 2 = 0),
n AS (SELECT video_id FROM (SELECT video_id, count(*) AS a FROM f GROUP BY 1) JOIN (SELECT video_id, count(*) AS b FROM v GROUP BY 1) USING (video_id) WHERE a = b)
SELECT f.video_id, f.frame_id, CAST(dim AS INTEGER) AS dim FROM f JOIN v USING (video_id, frame_id) JOIN n USING (video_id)""")
def j7_embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.concat(F.lit("v"), "vec_id").alias("frame_id"), F.size("embedding").alias("dim"), "vec_id")
    return store.embedding_rows(e.select("video_id", "frame_id"), e.where("video_id % 2 = 0 or vec_id % 2 = 0").select("video_id", "frame_id", "dim"), "video_id")


@_query(f"""WITH {_CHARGES} SELECT run_id, call_pos, CAST(CASE stage WHEN 'user' THEN 40.0 WHEN 'assistant' THEN 30.0 ELSE 0.0 END AS DOUBLE) AS money_limit FROM charges""")
def j9_stage_limit(spark: SparkSession, d: str) -> DataFrame:
    lim = _limits(spark).where("stage <> 'system'")
    return _charges(spark, d).join(lim, "stage", "left").select("run_id", "call_pos", F.coalesce("money_limit", F.lit(0.0)).alias("money_limit"))


@_query("""SELECT e.event_id FROM events e SEMI JOIN (SELECT doc_id AS user_id FROM labels WHERE toxic = 0) l USING (user_id)""")
def j10_seen(spark: SparkSession, d: str) -> DataFrame:
    ok = load(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("user_id"))
    return load(spark, d, "events").join(ok, "user_id", "left_semi").select("event_id")


@_query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Describe the view' WHEN 'error' THEN 'Read the message' ELSE 'Describe' END AS prompt FROM events")
def j13_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = store.prompt_for(F.col("event_type"), {"view": "Describe the view", "error": "Read the message"}, "Describe")
    return load(spark, d, "events").select("event_id", p.alias("prompt"))


@_query("SELECT user_id, list(event_id ORDER BY event_id) AS ids, string_agg(event_type, ' ' ORDER BY event_id) AS kinds FROM events GROUP BY user_id")
def a4_a5_ordered(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    g = load(spark, d, "events").groupBy("user_id").agg(pairs.alias("p"))
    return g.select("user_id", F.transform("p", lambda x: x["event_id"]).alias("ids"), F.array_join(F.transform("p", lambda x: x["event_type"]), " ").alias("kinds"))


@_query("SELECT user_id, min(value) AS low, max(value) AS high, first(event_id ORDER BY value, event_id) AS arg_low FROM events GROUP BY user_id")
def a6_extrema(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("event_id", F.struct("value", "event_id")).alias("arg_low"))


@_query("SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id")
def a7_first_match(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("p", F.struct("ts", "event_id"))
    return store.first_match(e, ["user_id"], "p", "event_id", F.col("event_type") == "error")


@_query(f"""WITH {_STORE} SELECT frame_id, CASE WHEN event_id % 5 = 0 THEN ['s0', 's1', 's2'] WHEN event_id % 5 = 1 THEN ['s1', 's0'] ELSE ['s0'] END AS consumed_by FROM store""")
def a8_mark_consumed(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d).withColumn("consumed_by", F.when(F.col("event_id") % 5 == 1, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s0"))))
    marks = s.select("frame_id", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit("s1"), F.lit("s0"), F.lit("s2"))).otherwise(F.array(F.lit("s0")))).alias("section_id")).withColumn("pos", F.when(F.col("section_id") == "s2", 9).otherwise(F.lit(1)))
    return store.mark_consumed(s, marks.select("frame_id", F.col("pos").cast("int"), "section_id")).select("frame_id", "consumed_by")


@_query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 10")
def k6_first_n(spark: SparkSession, d: str) -> DataFrame:
    return select.first_n(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], 10).select("event_id")


@_query("SELECT event_id, user_id, event_type IN ('view', 'error') AS known FROM events")
def u3_membership(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "user_id", F.col("event_type").isin("view", "error").alias("known"))


@_query(f"""WITH {_STORE} SELECT frame_id, coalesce(detail, sha256('vision' || chr(10) || brief)) AS detail FROM store""")
def m1_m2_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Details of all frames; the missing ones come from the deterministic provider."""
    s = _store(spark, d)

    def describe(misses: DataFrame) -> DataFrame:
        calls = misses.select("frame_id", F.lit("vision").alias("model"), F.col("brief").alias("prompt"))
        return models.chat(calls, models.FakeProvider).select("frame_id", F.col("reply").alias("detail"))

    return store.enrich_misses(s.select("frame_id", "brief"), s.where("detail is not null").select("frame_id", "detail"), describe)


@_query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND length(trim(text)) >= 30 THEN text ELSE text || ' and a fallback that is long enough' END AS reply FROM conversations")
def m3_fallback(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.lit(" short "))
    return load(spark, d, "conversations").select("conv_id", "turn", models.first_reply([first, F.concat("text", F.lit(" and a fallback that is long enough"))]).alias("reply"))


@_query("""WITH RECURSIVE o AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, sha256('writer' || chr(10) || text || chr(10)) AS md, sha256('writer' || chr(10) || text || chr(10)) AS written FROM o WHERE k = 1
 UNION ALL SELECT conv_id, turn, k, md, written || chr(10) || md FROM (SELECT o.conv_id, o.turn, o.k, f.written, sha256('writer' || chr(10) || o.text || chr(10) || right(f.written, 2000)) AS md FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1))
SELECT conv_id AS video_id, turn AS section_pos, md FROM f""")
def m6_write_in_turn(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("section_pos"), F.col("text").alias("prompt"))
    return models.write_in_turn(s, models.FakeProvider)
