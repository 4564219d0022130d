"""Timed text: clocks, formatting, sessions, paragraphs, windows and merged timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.scalars import ends_sentence, hms, strip


def sample_clock(ranges: DataFrame, fps: float, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each frame of each range: ``frame_idx`` from 0 and the midpoint ``timestamp``."""
    n = F.floor((F.col(end) - F.col(start)) * fps).cast("int")
    rows = ranges.where(n > 0).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("timestamp", F.col(start) + (F.col("frame_idx") + 0.5) / fps)


def mint_ids(df: DataFrame, prefix: str, partition: list[str], order: list[str], name: str = "id") -> DataFrame:
    """Ids such as p0000, counted within each partition; they widen beyond 9999."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.format_string(f"{prefix}%04d", F.row_number().over(w) - 1))


def gap_sessions(df: DataFrame, key: str, order: list[str], gap: Column) -> DataFrame:
    """The rows with ``session``, which counts up where ``gap`` (of a row and its predecessor) holds."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def sessions_by_time(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """(key, session, n, first, last) of runs without a pause longer than the gap (strictly)."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = gap_sessions(events.withColumn("_us", micros).withColumn("_prev", F.lag("_us").over(w)), key, [ts, tie], F.col("_us") - F.col("_prev") > int(gap_seconds * 1e6))
    return marked.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))


def paragraphs(segments: DataFrame, key: str = "video_id", *, gap: float = 1.5, soft_gap: float = 0.8, max_duration: float = 30.0) -> DataFrame:
    """(key, para_id, start, end, text, seg_indices) of each timeline's segments.

    A segment opens a paragraph if the pause before it exceeds ``gap``; or exceeds ``soft_gap``
    after the end of a sentence; or if its end lies more than ``max_duration`` beyond the
    paragraph's start. Blank segments are skipped, but the first segment's start opens the
    first paragraph even if that segment is blank.

    The pauses depend on neighbours alone, so they cut a timeline into islands with window
    functions. Only the duration rule needs a fold, which runs within an island and keeps the
    places where paragraphs begin.
    """
    w = Window.partitionBy(key).orderBy("seg_idx")
    rows = segments.withColumn("_seed", F.first("start").over(w)).withColumn("text", strip(F.col("text"))).where("text <> ''")
    pause = F.col("start") - F.lag("end").over(w)
    opens = (pause > gap) | ((pause > soft_gap) & ends_sentence(F.lag("text").over(w)))
    islands = gap_sessions(rows.withColumn("_opens", opens), key, ["seg_idx"], F.col("_opens"))
    seg = F.struct("seg_idx", "start", "end", "text")
    grouped = islands.groupBy(key, "session").agg(F.array_sort(F.collect_list(seg)).alias("segs"), F.min_by("_seed", "seg_idx").alias("_seed"))
    seed = F.when(F.col("session") == 0, F.col("_seed")).otherwise(F.col("segs")[0]["start"])
    state = F.struct(seed.alias("begin"), F.lit(0).alias("i"), F.array(F.struct(F.lit(0).alias("i"), seed.alias("begin"))).alias("cuts"))

    def fold(a: Column, s: Column) -> Column:
        late = (a["i"] > 0) & (s["end"] - a["begin"] > max_duration)
        begin = F.when(late, s["start"]).otherwise(a["begin"])
        cuts = F.when(late, F.concat(a["cuts"], F.array(F.struct(a["i"].alias("i"), s["start"].alias("begin"))))).otherwise(a["cuts"])
        return F.struct(begin.alias("begin"), (a["i"] + 1).alias("i"), cuts.alias("cuts"))

    folded = grouped.withColumn("cuts", F.aggregate("segs", state, fold)["cuts"])
    parts = folded.select(key, "session", "segs", "cuts", F.posexplode("cuts").alias("k", "cut"))
    stop = F.coalesce(F.get("cuts", F.col("k") + 1)["i"], F.size("segs"))
    parts = parts.withColumn("own", F.slice("segs", F.col("cut.i") + 1, stop - F.col("cut.i")))
    shaped = parts.select(
        key, "session", "k", F.col("cut.begin").alias("start"), F.element_at("own", -1)["end"].alias("end"),
        F.array_join(F.transform("own", lambda s: s["text"]), " ").alias("text"), F.transform("own", lambda s: s["seg_idx"]).alias("seg_indices"),
    )
    return mint_ids(shaped, "p", [key], ["session", "k"], "para_id").select(key, "para_id", "start", "end", "text", "seg_indices")


def overlapping(df: DataFrame, start: float, end: float) -> DataFrame:
    """Rows that overlap a window; touching does not count."""
    return df.where((F.col("end") > start) & (F.col("start") < end))


def transcript_window(paras: DataFrame, key: str, start: float, end: float, max_chars: int = 3000, order: str = "para_id") -> DataFrame:
    """(key, window_text): lines of overlapping paragraphs up to the one that would exceed the budget."""
    line = F.concat(F.lit("["), hms(F.col("start")), F.lit("] "), F.col("text"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = overlapping(paras, start, end).withColumn("_line", line).withColumn("_used", F.sum(F.length("_line")).over(w)).where(F.col("_used") <= max_chars)
    return ordered_text(kept, [key], order, F.col("_line"), "\n", "window_text")


def ordered_text(df: DataFrame, keys: list[str], order: str, value: Column, sep: str, name: str) -> DataFrame:
    """Values of each group joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), sep).alias(name))


def format_transcript(segments: DataFrame, key: str = "video_id") -> DataFrame:
    line = F.concat(F.lit("["), hms(F.col("start")), F.lit("] "), F.col("text"))
    return ordered_text(segments, [key], "seg_idx", line, "\n", "transcript")


def merged_timeline(segments: DataFrame, frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Speech and frames in one order of time; on ties speech comes first, then list order."""
    a = segments.select(key, F.col("start").alias("ts"), F.lit(0).alias("kind_rank"), F.lit("speech").alias("kind"), F.col("seg_idx").alias("idx"), F.col("text").alias("content"))
    b = frames.select(key, F.col("timestamp").alias("ts"), F.lit(1).alias("kind_rank"), F.lit("frame").alias("kind"), F.col("frame_idx").alias("idx"), F.col("description").alias("content"))
    w = Window.partitionBy(key).orderBy("ts", "kind_rank", "idx")
    return a.unionByName(b).withColumn("position", F.row_number().over(w)).drop("kind_rank")


def truncated(df: DataFrame, seconds: float, start: str = "start") -> DataFrame:
    return df.where(F.col(start) < seconds)


def running_tail(sections: DataFrame, key: str, order: str, text: str, n_chars: int = 2000) -> DataFrame:
    """The rows with ``written_tail``: the end of all that stands before each.

    A row gathers only rows that end within ``n_chars`` of its end, by a range over running
    lengths, so what is held does not grow with what stands before. One that ends just there
    counts too, as the line break after it is the tail's first character.
    """
    w = Window.partitionBy(key).orderBy(order)
    until = sections.withColumn("_until", F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(key).orderBy("_until").rangeBetween(-n_chars, 0)
    tail = F.right(F.array_join(F.collect_list(F.right(F.col(text), F.lit(n_chars))).over(near), "\n"), F.lit(n_chars))
    return until.withColumn("_tail", tail).withColumn("written_tail", F.coalesce(F.lag("_tail").over(w), F.lit(""))).drop("_until", "_tail")


def length_chunks(df: DataFrame, key: str, order: str, text: str, size: int) -> DataFrame:
    """The rows with ``chunk``: which stretch of ``size`` characters each begins in."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("chunk", F.floor(F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)) / size))
