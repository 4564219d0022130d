"""The streaming operators over the driver's tables, drained into tables; SQL says what they have to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.plans.inputs import segments
from timeloom.plans.table_queries import ORACLES as TABLES
from timeloom.plans.table_queries import _charges
from timeloom.plans.time_queries import ORACLES as TIMES
from timeloom.session import load
from timeloom.storage import shared_dir, written
from timeloom.streaming import stateful, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Seconds at which the rows that end a bounded stream lie, far behind all others.
_END = 4_000_000_000


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Rows of a file of a stream; a part has as many files as the cluster has cores at most.
_FILE_ROWS = 20_000


def _as_stream(rows: DataFrame, parts: list, end: DataFrame | None = None) -> DataFrame:
    """The rows as files, those of each condition apart and in this order, then ``end``; read as a stream, a part at a time.

    Every part is written and read by several tasks once it is large. A part of fewer files than another may share a
    trigger with the next one, but no row comes before those of the parts ahead of its own.
    """
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    rows = written(rows)
    files = max(1, min(spark.sparkContext.defaultParallelism, rows.count() // (_FILE_ROWS * len(parts))))
    for condition in parts:
        rows.where(condition).repartition(files).write.mode("append").parquet(folder)
    if end is not None:
        end.select(rows.columns).coalesce(1).write.mode("append").parquet(folder)
    return streams.file_stream(spark, folder, rows.schema, "*.parquet", files)


@_query(TABLES["b3_admission_each"])
def b3_ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """The calls of all runs as they come, a third of each run at a time; runs close when the stream's last row comes."""
    calls = _charges(spark, d).withColumn("at", F.timestamp_seconds(F.col("call_pos") + 60))
    end = spark.createDataFrame([(-1, 0, "user", 0.0, 0.0, _END)], "run_id long, call_pos int, stage string, estimate double, actual double, at long").withColumn("at", F.timestamp_seconds("at"))
    end = end.select(*(F.col(c).cast(calls.schema[c].dataType) for c in calls.columns))
    limits = {"user": (40.0, 4), "assistant": (30.0, 3), "system": (16.0, 1)}
    s = _as_stream(calls, [F.col("call_pos") < 3, F.col("call_pos").between(3, 6), F.col("call_pos") > 6], end)
    out = streams.drain(stateful.ledger_stream(s, limits, 60.0, "at", "1 hour", 600.0))
    return out.where("verdict <> 'closed' AND run_id >= 0").select("run_id", F.col("call_pos").cast(calls.schema["call_pos"].dataType).alias("call_pos"), "verdict")


@_query(TIMES["w1_paragraphs"])
def w1_paragraph_stream(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all timelines in two parts that are not in order of time; the last row lets the watermark pass."""
    s = segments(spark, d).select("video_id", "seg_idx", "start", "end", "text")
    end = spark.createDataFrame([(-1, 0, float(_END), float(_END), "")], s.schema)
    stream = _as_stream(s, [F.col("seg_idx") % 2 == 1, F.col("seg_idx") % 2 == 0], end)
    return streams.drain(stateful.paragraph_stream(stream, delay="1 day")).where("video_id >= 0")


@_query("""SELECT event_id, s AS section_pos FROM events, range(0, 12) r(s)
WHERE ts >= TIMESTAMP '2024-01-01' + INTERVAL '72 hours' * s AND ts < TIMESTAMP '2024-01-01' + INTERVAL '72 hours' * s + INTERVAL '60 hours'""")
def j1_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Events and sections of each user as two streams: sections of sixty hours, one every three days."""
    events = load(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    begin = F.lit("2024-01-01").cast("timestamp").cast("long")
    sections = events.select("user_id").distinct().withColumn("section_pos", F.explode(F.sequence(F.lit(0), F.lit(11))))
    sections = sections.withColumn("begins", F.timestamp_seconds(begin + F.col("section_pos") * 72 * 3600)).withColumn("ends", F.timestamp_seconds(begin + F.col("section_pos") * 72 * 3600 + 60 * 3600))
    left = _as_stream(events, [F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1])
    right = _as_stream(sections, [F.col("section_pos") % 3 != 0, F.col("section_pos") % 3 == 0])
    joined = stateful.section_frames_stream(left, right, "user_id", "ts", "begins", "ends", "60 days", "60 hours")
    return streams.drain(joined.select("event_id", F.col("section_pos").cast("long").alias("section_pos")))


@_query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_tumbling_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts by window and type as a stream; an event far behind all others closes the last window."""
    events = load(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = events.limit(0).unionByName(spark.createDataFrame([("", _END)], "event_type string, ts long").withColumn("ts", F.timestamp_seconds("ts")))
    s = _as_stream(events, [F.second("ts") < 30, F.second("ts") >= 30], end)
    out = streams.drain(streams.tumbling_counts(s, "ts", "6 hours", ["event_type"], "90 days"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def x_distinct_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type, as a stream in two parts."""
    events = load(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    s = _as_stream(events, [F.second("ts") < 30, F.second("ts") >= 30])
    return streams.drain(streams.distinct_stream(s, ["user_id", "event_type"], "ts", "90 days").select("user_id", "event_type"))
