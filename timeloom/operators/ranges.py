"""Range, band and nearest joins over intervals, by bins of as many widths as they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The least exponent of a bin's width, for intervals of hardly any length.
FINEST = -20


def range_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, how: str = "inner", closed_end: bool = False) -> DataFrame:
    """Points and the intervals that hold them: ``start <= at < end`` (``<= end`` if closed).

    An interval's own length tells the width of its bins: the next power of two, so it touches
    two bins at most, however long it is. A point looks into its bin of every width that the intervals
    of its key have, and an equal join on (key, width, bin) leaves little for the exact test.
    ``how`` may be inner or left (all points). A null bound or point matches nothing.
    """
    i = intervals.where((F.col(end) >= F.col(start)) & F.col(key).isNotNull()).withColumnRenamed(key, "_ikey")
    length = F.greatest(F.col(end).cast("double") - F.col(start).cast("double"), F.lit(2.0**FINEST))
    i = i.withColumn("_level", F.least(F.ceil(F.log2(length)), F.lit(1000)).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_level"))
    bins = F.array(F.floor(F.col(start) / width), F.floor(F.least(F.col(end).cast("double"), F.col(start) + width) / width))
    i = i.withColumn("_ibin", F.explode(F.array_distinct(bins)))
    levels = i.groupBy("_ikey").agg(F.collect_set("_level").alias("_levels"))
    p = points.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else points
    looking = p.where(F.col(at).isNotNull()).join(levels, F.col(key) == F.col("_ikey")).drop("_ikey").withColumn("_plevel", F.explode("_levels")).drop("_levels")
    looking = looking.withColumn("_bin", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_plevel"))))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed_end else (F.col(at) < F.col(end)))
    hits = looking.join(i, (F.col(key) == F.col("_ikey")) & (F.col("_plevel") == F.col("_level")) & (F.col("_bin") == F.col("_ibin")) & inside).drop("_ikey", "_plevel", "_level", "_bin", "_ibin")
    if how == "inner":
        return hits
    return p.join(hits.drop(*points.columns), "_row", how).drop("_row")


def assign_to_sections(frames: DataFrame, sections: DataFrame, key: str, section_id: str, at: str, idx: str) -> DataFrame:
    """The sections with ``frame_ids``: indices of the frames in [start, end), in order; empty if none."""
    sec = sections.select(key, section_id, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hits = range_join(frames.select(key, F.col(at).alias("_at"), F.col(idx).alias("_idx")), sec, key, "_at", "_s", "_e")
    ids = hits.groupBy(key, section_id).agg(F.array_sort(F.collect_list("_idx")).alias("frame_ids"))
    empty = F.array().cast(f"array<{frames.schema[idx].dataType.simpleString()}>")
    return sections.join(ids, [key, section_id], "left").withColumn("frame_ids", F.coalesce("frame_ids", empty))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, right_order: str, value: str, name: str = "nearest") -> DataFrame:
    """For each left row (told by all its columns) the value of the right row nearest in time.

    Ties go to the one that stands first in ``right_order``. It needs no pairs: within a key the
    rows of both sides are put in one order, and the last right row before and the first after
    each left row are its only candidates.
    """
    from pyspark.sql import Window

    cand = right.groupBy(key, F.col(right_at).alias("_t")).agg(F.min_by(F.struct(F.col(right_order).alias("o"), F.col(value).alias("v")), right_order).alias("_c"))
    both = left.withColumns({"_t": F.col(at), "_left": F.lit(1)}).unionByName(cand.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    mark = F.when(F.col("_left") == 0, F.struct("_t", "_c"))
    up = Window.partitionBy(key).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.col("_t").desc(), "_left").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_a": F.last(mark, True).over(up), "_b": F.last(mark, True).over(down)}).where("_left = 1")
    da, db = F.abs(F.col("_a._t") - F.col("_t")), F.abs(F.col("_b._t") - F.col("_t"))
    first = F.col("_b").isNull() | (da < db) | ((da == db) & (F.col("_a._c.o") <= F.col("_b._c.o")))
    best = F.when(F.col("_a").isNotNull() & first, F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn("_best", best).withColumns({name: F.col("_best._c.v"), "distance": F.abs(F.col("_best._t") - F.col("_t"))}).select(*left.columns, name, "distance")


def band_distance(points: DataFrame, anchors: DataFrame, key: str, at: str, anchor_at: str, width: float) -> DataFrame:
    """The points with ``anchor_distance`` to the nearest anchor less than ``width`` away, or null."""
    ids = points.withColumn("_row", F.monotonically_increasing_id())
    near = F.explode(F.array(*(F.floor(F.col(at) / width) + d for d in (-1, 0, 1))))
    a = anchors.select(F.col(key).alias("_k"), F.col(anchor_at).alias("_a"), F.floor(F.col(anchor_at) / width).alias("_abin")).distinct()
    p = ids.select("_row", key, at).withColumn("_bin", near)
    d = F.abs(F.col(at) - F.col("_a"))
    hits = p.join(a, (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_abin")) & (d < width)).groupBy("_row").agg(F.min(d).alias("anchor_distance"))
    return ids.join(hits, "_row", "left").drop("_row")


def within_tolerance(stamps: DataFrame, segments: DataFrame, key: str, at: str, tolerance: float) -> DataFrame:
    """The stamps with ``valid``: whether some segment, widened by the tolerance (closed), holds them."""
    wide = segments.select(key, (F.col("start") - tolerance).alias("_s"), (F.greatest("start", "end") + tolerance).alias("_e"))
    cells = stamps.select(key, at).distinct()
    ok = range_join(cells, wide, key, at, "_s", "_e", closed_end=True).select(key, at).distinct().withColumn("valid", F.lit(True))
    return stamps.join(ok, [key, at], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def not_in_ranges(points: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """Points that lie in no interval (skipped windows)."""
    sec = intervals.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = range_join(points.select(key, at).distinct(), sec, key, at, "_s", "_e").select(key, at).distinct()
    return points.join(hit, [key, at], "left_anti")


def anchor_score(distance: Column) -> Column:
    return F.when(distance < 2, 10.0).when(distance < 5, 5.0).otherwise(0.0)
