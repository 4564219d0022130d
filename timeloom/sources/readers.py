"""Readers and sinks of the formats around a video's working folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.operators.text import parse_captions

SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
PARAGRAPH = T.StructType([
    T.StructField("para_id", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
    T.StructField("text", T.StringType()), T.StructField("seg_indices", T.ArrayType(T.IntegerType())),
])
META = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("video_path", "subtitle_path", "title", "uploader")),
    T.StructField("duration", T.DoubleType()), T.StructField("description", T.StringType()), T.StructField("url", T.StringType()),
])


def _video_id() -> F.Column:
    """The name of the folder that holds the file."""
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = False, position: str | None = "pos") -> DataFrame:
    """Elements of files that each hold one JSON array, with their folder as ``video_id``.

    Lenient: unknown keys are ignored and missing ones are null. Strict: a key that the schema
    does not have is an error (the reader alone would ignore it).
    """
    whole = spark.read.text(path, wholetext=True).select(_video_id().alias("video_id"), F.col("value"))
    if strict:
        names = set(schema.fieldNames())
        keys = whole.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m")).select(F.explode(F.map_keys("m")).alias("k")).distinct()
        odd = [r.k for r in keys.where(~F.col("k").isin(sorted(names))).limit(5).collect()]
        if odd:
            raise ValueError(f"unknown keys: {odd}")
    rows = whole.select("video_id", F.posexplode(F.from_json("value", T.ArrayType(schema))).alias(position or "_pos", "_e")).select("video_id", position or "_pos", "_e.*")
    return rows if position else rows.drop("_pos")


def read_segments(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read_json_array(spark, path, SEGMENT, strict=strict, position="seg_idx")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Segments of WebVTT files."""
    return parse_captions(spark.read.text(path, wholetext=True).select(_video_id().alias("video_id"), "value"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).json(path).withColumn("video_id", _video_id())


def write_json_array(df: DataFrame, path: str, key: str, order: str) -> None:
    """One line for each key: an array of its rows in order, UTF-8 as it is."""
    cols = [c for c in df.columns if c != key]
    arr = F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
    df.groupBy(key).agg(F.to_json(arr).alias("value")).select("value").write.mode("overwrite").text(path)


def cookie_header(lines: DataFrame, domain: str, value: str = "value") -> DataFrame:
    """(header): ``name=value`` pairs, in file order, of tab-separated rows for a domain.

    Comments, blank lines and rows of fewer than seven fields are skipped. ``lines`` has ``pos``.
    """
    parts = F.split(F.col(value), "\t")
    rows = lines.where(~F.col(value).startswith("#") & (F.trim(value) != "") & (F.size(parts) >= 7)).where(F.contains(F.lower(parts[0]), F.lit(domain)))
    pair = F.struct("pos", F.concat(parts[5], F.lit("="), parts[6]).alias("p"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["p"]), "; ").alias("header"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, name) of matching files, in order; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("path")


def files_to_prune(listing: DataFrame, keep: DataFrame, name: str = "name") -> DataFrame:
    """Files that are not kept; deleting them is left to the caller."""
    return listing.join(keep.select(name).distinct(), name, "left_anti")


def existing(rows: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Cached rows whose file is there."""
    return rows.join(listing.select(path).distinct(), path, "left_semi")


def read_limits(spark: SparkSession, path: str, rate: float) -> DataFrame:
    """(stage, money_limit in dollars, call_limit) of a configuration with two-level ``key: value`` lines."""
    money: dict[str, float] = {}
    calls: dict[str, int] = {}
    section = None
    for raw in (r.value for r in spark.read.text(path).toLocalIterator()):
        line = raw.split("#")[0].rstrip()
        if not line.strip() or ":" not in line:
            continue
        name, _, value = line.strip().partition(":")
        if not line.startswith(" "):
            section = name if not value.strip() else None
        elif section and "call" in section:
            calls[name] = int(value)
        elif section:
            money[name] = float(value)
    return spark.createDataFrame([(s, money.get(s, 0.0) / rate, calls.get(s, 0)) for s in sorted({*money, *calls})], "stage string, money_limit double, call_limit int")


def write_documents(documents: DataFrame, path: str, key: str = "video_id", text: str = "document") -> None:
    """A text file for each document, in a folder for each key."""
    documents.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def dump_raw_output(outputs: DataFrame, path: str) -> None:
    """Append raw model output (run_id, stage, attempt, text) to an audit table."""
    outputs.write.mode("append").partitionBy("stage").parquet(path)


def navigate(raw: F.Column) -> dict[str, F.Column]:
    """Columns of a nested detail reply: the first http address and the fields of its metadata,
    each empty where a level is missing."""
    schema = "aweme_detail struct<desc:string,aweme_id:string,author:struct<nickname:string>,video:struct<duration:double,play_addr:struct<url_list:array<string>>>>"
    d = F.from_json(raw, schema)["aweme_detail"]
    urls = F.coalesce(d["video"]["play_addr"]["url_list"], F.array().cast("array<string>"))
    return {
        "url": F.get(F.filter(urls, lambda u: u.startswith("http")), F.lit(0)),
        "title": F.left(F.coalesce(d["desc"], F.lit("")), F.lit(200)),
        "uploader": F.coalesce(d["author"]["nickname"], F.lit("")),
        "duration": F.coalesce(d["video"]["duration"], F.lit(0.0)) / 1000,
        "media_id": d["aweme_id"],
    }


def to_json_text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
