"""Logical inputs of the operators, made from the driver's tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.session import load

#: Frames count seconds from here.
BASE = "2024-01-01 00:00:00"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed speech: 20 characters a second, and pauses that vary by turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf_dir, "conversations")
    pause = (F.col("turn") * 7 % 5) * 500
    rows = c.withColumns({"_len": F.length("text") * 50, "_pause": pause})
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_len").over(up) + F.sum("_pause").over(up)
    return rows.withColumn("_end", end).select(
        F.col("conv_id").alias("video_id"),
        (F.row_number().over(w) - 1).cast("int").alias("seg_idx"),
        ((F.col("_end") - F.col("_len")) / 1000.0).alias("start"),
        (F.col("_end") / 1000.0).alias("end"),
        "text", "role",
    )


SEGMENTS = """segments AS (
  SELECT conv_id AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seg_idx,
    CAST(e - l AS BIGINT) / 1000.0::DOUBLE AS "start", CAST(e AS BIGINT) / 1000.0::DOUBLE AS "end", text, role
  FROM (SELECT *, length(text) * 50 AS l,
      sum(length(text) * 50 + (turn * 7 % 5) * 500) OVER (PARTITION BY conv_id ORDER BY turn) AS e, turn AS t0
    FROM conversations))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of their user: time in seconds, value as score, a made-up 64-bit hash
    (null for one in seven)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events")
    bits = (F.col("event_id") * F.col("event_id") * 31 + F.col("event_id")) % 1048576
    return e.select(
        F.col("user_id").alias("video_id"), "event_id",
        (F.row_number().over(w) - 1).cast("int").alias("frame_idx"),
        (F.timestamp_diff("MICROSECOND", F.expr(f"TIMESTAMP_NTZ'{BASE}'"), F.col("ts")) / 1e6).alias("timestamp"),
        F.when(F.col("event_id") % 7 != 0, bits).alias("phash_bits"),
        F.col("event_type").alias("type"), F.col("value").alias("score"),
    )


FRAMES = f"""frames AS (
  SELECT user_id AS video_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
    (epoch_us(ts) - epoch_us(TIMESTAMP '{BASE}')) / 1e6::DOUBLE AS "timestamp",
    CASE WHEN event_id % 7 <> 0 THEN (event_id * event_id * 31 + event_id) % 1048576 END AS phash_bits,
    event_type AS type, value AS score
  FROM events)"""


def sections(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Sections of six hours over the first days for each user; every fifth one is left out."""
    users = load(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    s = users.withColumn("section_pos", F.explode(F.sequence(F.lit(0), F.lit(119)))).where("section_pos % 5 <> 4")
    return s.select("video_id", "section_pos", F.format_string("s%d", "section_pos").alias("section_id"), (F.col("section_pos") * hours * 3600.0).cast("double").alias("start"), ((F.col("section_pos") + 1) * hours * 3600.0).cast("double").alias("end"))


SECTIONS = """sections AS (
  SELECT u.video_id, CAST(p AS INTEGER) AS section_pos, 's' || p AS section_id, CAST(p * 21600 AS DOUBLE) AS "start", CAST((p + 1) * 21600 AS DOUBLE) AS "end"
  FROM (SELECT DISTINCT user_id AS video_id FROM events) u, range(0, 120) r(p) WHERE p % 5 <> 4)"""


def hms_sql(x: str) -> str:
    return f"printf('%02d:%02d:%02d', CAST(trunc({x}) AS BIGINT) // 3600, CAST(trunc({x}) AS BIGINT) % 3600 // 60, CAST(trunc({x}) AS BIGINT) % 60)"


STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
