"""Streams: sessions, windows and first events under a watermark, and commits of what a stream makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from timeloom.storage import shared_dir


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of events; a pause of the gap or longer closes one. Later events than the delay go."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def tumbling_counts(events: DataFrame, ts: str, width: str, keys: list[str], delay: str) -> DataFrame:
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def distinct_stream(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First event of each key within the delay."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys).drop("_ts")


def append_sections(stream: DataFrame, table: str, checkpoint: str, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Commit sections as they are made, each trigger's once.

    A trigger writes its rows to a folder of its own number, over what an attempt that broke off
    may have left there, and then a mark in ``_commits``. A trigger that runs again after a failure
    replaces its own rows or, if its mark is there, does nothing. :func:`committed` reads what is
    marked. ``after_write`` is called between the two steps (for tests of failures).
    """

    def put(batch: DataFrame, epoch: int) -> None:
        if epoch in _marks(batch.sparkSession, table):
            return
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        if after_write:
            after_write(epoch)
        fs, path = _file_system(batch.sparkSession, f"{table}/_commits/{epoch}")
        fs.create(path, True).close()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The rows of all triggers that were committed, with their number as ``epoch``."""
    done = [f"{table}/epoch={e}" for e in sorted(_marks(spark, table))]
    if not done:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("epoch", T.LongType())]))
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).option("basePath", table)
    return read.parquet(*done)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _marks(spark: SparkSession, table: str) -> set[int]:
    fs, at = _file_system(spark, f"{table}/_commits")
    return {int(f.getPath().getName()) for f in fs.listStatus(at)} if fs.exists(at) else set()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    table, checkpoint = shared_dir(spark), shared_dir(spark)
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)
