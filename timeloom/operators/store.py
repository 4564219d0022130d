"""The keyed frame store: listing, counts, details on demand and marks of use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_frames(store: DataFrame, kind: str | None = None, exclude: list[str] | None = None, time_range: tuple[float, float] | None = None) -> DataFrame:
    """Short rows of the store's frames: by type, without excluded types, in a closed time range."""
    rows = store
    if kind:
        rows = rows.where(F.col("type") == kind)
    if exclude:
        rows = rows.where(~F.col("type").isin(exclude))
    if time_range:
        rows = rows.where(F.col("timestamp").between(*time_range))
    return rows.select("video_id", "frame_id", "timestamp", "type", "has_text", "brief", F.col("detail").isNotNull().alias("has_detail"), F.bround("info_score", 1).alias("info_score"))


def counts_in_domain(rows: DataFrame, value: str, domain: list[str], keys: list[str]) -> DataFrame:
    """A count for each key and each value of a fixed domain, 0 where there is none."""
    n = [F.count_if(F.col(value) == d).alias(d) for d in domain]
    wide = rows.groupBy(*keys).agg(*n) if keys else rows.agg(*n)
    return wide.select(*keys, F.explode(F.array(*(F.struct(F.lit(d).alias(value), F.col(d).alias("n")) for d in domain))).alias("x")).select(*keys, f"x.{value}", "x.n")


def zipped(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides side by side by position; the shorter side ends it."""
    a = left.withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    return a.join(b, [key, "_pos"]).withColumnRenamed("_pos", "position")


def mark_consumed(store: DataFrame, marks: DataFrame) -> DataFrame:
    """The store with sections added to ``consumed_by``, each once, in order of arrival."""
    new = marks.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section_id"))).alias("_m"))
    added = F.transform(F.coalesce("_m", F.array().cast("array<struct<pos:int,section_id:string>>")), lambda m: m["section_id"])
    return store.join(new, "frame_id", "left").withColumn("consumed_by", F.array_union(F.coalesce("consumed_by", F.array().cast("array<string>")), added)).drop("_m")


def enrich_misses(store: DataFrame, details: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Details of all frames: the kept ones, and new ones for the frames that have none.

    Only misses reach ``describe``, which returns (frame_id, detail); append them to the table
    of details, so that a frame is described once.
    """
    misses = store.join(details.select("frame_id"), "frame_id", "left_anti")
    return details.select("frame_id", "detail").unionByName(describe(misses).select("frame_id", "detail"))


def prompt_for(kind: Column, prompts: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in prompts.items() for x in kv)), kind), F.lit(default))


def missing(planned: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(written.select(*keys).distinct(), keys, "left_anti")


def first_match(rows: DataFrame, keys: list[str], priority: str, value: str, keep: Column) -> DataFrame:
    """The value of the first row that passes, by priority."""
    return rows.where(keep).groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def canonical_terms(texts: DataFrame, aliases: dict[str, str], text: str) -> DataFrame:
    """Glossary: whole-word aliases become their terms, longest alias first."""
    out = F.col(text)
    for alias, term in sorted(aliases.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = F.regexp_replace(out, rf"(?i)\b{alias}\b", term)
    return texts.withColumn(text, out)


def embedding_rows(frames: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Frames with their vectors; nothing for a key whose counts differ."""
    n = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_a")).join(vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_b")), key).where("_a = _b").select(key)
    return frames.join(vectors, [key, "frame_id"]).join(n, key, "left_semi")


def config_rows(spark: SparkSession, stages: dict[str, tuple[float, int]], rate: float) -> DataFrame:
    """Limits by stage, money turned from yuan into dollars at load."""
    return spark.createDataFrame([(s, m / rate, n) for s, (m, n) in stages.items()], "stage string, money_limit double, call_limit int")
