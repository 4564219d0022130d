"""Queries of checks, templates, providers and defaults."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.scalars import render
from timeloom.operators import checks, ledger, models, select, timeline, vectors
from timeloom.plans.inputs import FRAMES, SECTIONS, SEGMENTS, frames, hms_sql, sections, segments
from timeloom.plans.table_queries import ORACLES as TABLE_ORACLES
from timeloom.plans.table_queries import _charges, _limits
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


@_query("SELECT conv_id, turn, 'Role {x}: ' || role || chr(10) || 'Turn ' || turn || ' of ' || conv_id || chr(10) || coalesce(CASE WHEN turn % 2 = 0 THEN text END, '') AS prompt FROM conversations")
def r10_prompt(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 2 == 0, F.col("text"))
    c = load(spark, d, "conversations")
    return c.select("conv_id", "turn", render("Role {{x}}: {role}\nTurn {turn} of {conv}\n{text}", role=F.col("role"), turn=F.col("turn"), conv=F.col("conv_id"), text=text).alias("prompt"))


@_query("""SELECT conv_id, turn, list_transform(range(0, 8), lambda i: ('0x' || substring(sha256(text), 2 * i + 1, 2))::INT / 255.0::DOUBLE) AS embedding FROM conversations""")
def m4_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").select("conv_id", "turn", "text")
    return models.embed(rows, models.FakeEmbedder, "text").select("conv_id", "turn", "embedding")


def _as_picture(content: bytes) -> np.ndarray:
    return np.frombuffer(content, dtype=np.uint8).astype(np.float64).reshape(32, 32)


@_query()
def m5_picture_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of pictures made from digests; the transform is beyond SQL, and a test restates it."""
    pixels = F.unhex(F.concat(*(F.sha2(F.concat(F.col("vec_id"), F.lit(f":{k}")), 256) for k in range(32))))
    return models.hash_pictures(load(spark, d, "embeddings").select("vec_id", pixels.alias("content")), _as_picture)


class _Moody(models.FakeProvider):
    """Fails for models whose name ends in an odd digit."""

    def complete(self, model: str, prompts: list[str], max_tokens: int, temperature: float) -> list[tuple[str | None, str | None]]:
        if int(model[-1]) % 2:
            raise RuntimeError(f"{model} is away")
        return super().complete(model, prompts, max_tokens, temperature)


@_query("SELECT 'm' || n_nationkey AS model, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 1 THEN 'm' || n_nationkey || ' is away' END AS error FROM nation")
def m7_probe(spark: SparkSession, d: str) -> DataFrame:
    return models.probe(load(spark, d, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("model")), _Moody)


_DETAILS = FRAMES + ", shown AS (SELECT video_id, \"timestamp\", 'shows value_' || (event_id % 5) || ' here' AS detail FROM frames WHERE event_id % 3 = 0)"


@_query(f"""WITH {_DETAILS}, {SECTIONS} SELECT s.video_id, s.section_id, EXISTS (SELECT 1 FROM shown f WHERE f.video_id = s.video_id AND f."timestamp" >= s."start" AND f."timestamp" < s."end"
 AND contains(f.detail, 'value_' || (s.section_pos % 6))) AS verified FROM sections s""")
def v1_code_in_frames(spark: SparkSession, d: str) -> DataFrame:
    shown = frames(spark, d).where("event_id % 3 = 0").select("video_id", "timestamp", F.concat(F.lit("shows value_"), F.col("event_id") % 5, F.lit(" here")).alias("detail"))
    blocks = sections(spark, d).withColumn("code", F.concat(F.lit(" value_"), F.col("section_pos") % 6, F.lit("\n")))
    return checks.code_in_frames(blocks, shown, "video_id", "section_id")


@_query(f"""WITH {SEGMENTS} SELECT video_id, seg_idx, starts_with(sha256('verifier' || chr(10) || 'Claim: ' || role || chr(10) || 'Transcript: ' || text), '1') AS supported FROM segments""")
def v2_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d).select("video_id", "seg_idx", F.col("role").alias("claim"), F.col("text").alias("transcript"))
    return checks.claims_held(rows, models.FakeProvider, yes="1").select("video_id", "seg_idx", "supported")


@_query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS t FROM documents), terms(term) AS (VALUES ('The'), ('con'), ('une'), ('und'), ('nothing'))
SELECT doc_id, term FROM documents, terms WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = documents.doc_id AND w.t = lower(term))""")
def v3_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    terms = docs.select("doc_id", F.explode(F.array(*map(F.lit, ("The", "con", "une", "und", "nothing")))).alias("term"))
    return checks.missing_terms(docs, terms, "doc_id")


_PASS = """SELECT * FROM (SELECT unnest([{'metric': 'sections', 'value': s, 'target': 0.9::DOUBLE, 'passed': s >= 0.9}, {'metric': 'filler', 'value': f, 'target': 2.0::DOUBLE, 'passed': f <= 2}], recursive := true)
FROM (SELECT round(avg(CASE WHEN length(text) >= 80 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS s, count(*) FILTER (length(text) < 20)::DOUBLE AS f FROM conversations))"""


@_query(_PASS)
def v4_pass_marks(spark: SparkSession, d: str) -> DataFrame:
    good = F.round(F.avg(F.when(F.length("text") >= 80, 1.0).otherwise(0.0)), 9)
    return checks.pass_marks(load(spark, d, "conversations"), {"sections": (good, 0.9, True), "filler": (F.count_if(F.length("text") < 20), 2.0, False)})


_U = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 0.01) FROM embeddings)"""


@_query(f"""WITH {_U}, n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM u), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / x.l / y.l AS score FROM n x JOIN n y ON x.vec_id < y.vec_id)
SELECT a, b, round(score, 6) AS score FROM p WHERE score > 0.95""")
def d8_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    both = e.unionAll(e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: x + 0.01).alias("embedding")))
    return vectors.near_vectors(both, "vec_id", "embedding", 0.95).select("a", "b", F.round("score", 6).alias("score"))


@_query(f"""WITH {SEGMENTS} SELECT video_id, seg_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx DESC) AS r FROM segments) WHERE r <= 2""")
def u4_last_sections(spark: SparkSession, d: str) -> DataFrame:
    return select.last_n(segments(spark, d), ["video_id"], ["seg_idx"], 2).select("video_id", "seg_idx", "text")


@_query(f"""WITH v AS ({TABLE_ORACLES["b3_admission"]}) SELECT run_id, call_pos, CASE WHEN verdict = 'admitted' THEN stage ELSE 'transition' END AS stage FROM v JOIN (SELECT conv_id AS run_id, turn AS call_pos, role AS stage FROM conversations) USING (run_id, call_pos)""")
def b8_defaults(spark: SparkSession, d: str) -> DataFrame:
    judged = ledger.admit_until_reject(_charges(spark, d), _limits(spark), 60.0)
    return checks.defaults_for_rejected(judged, {"stage": "transition"}).select("run_id", "call_pos", "stage")


@_query(f"""WITH {SEGMENTS} SELECT video_id, '# T' || video_id || chr(10) || chr(10) || '[no outline]' || chr(10) || chr(10) || string_agg('[' || {hms_sql('"start"')} || '] ' || text, chr(10) ORDER BY seg_idx) AS document FROM segments WHERE video_id % 3 = 0 GROUP BY video_id""")
def u5_transcript_instead(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    meta = s.select("video_id").distinct().withColumn("title", F.concat(F.lit("T"), "video_id"))
    failed = meta.where("video_id % 3 = 0").select("video_id", F.lit("no outline").alias("reason"))
    return checks.transcript_instead(meta, timeline.format_transcript(s), failed)
