"""Scores of frames from their perceptual hashes and from spoken anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.scalars import hamming


def novelty(frames: DataFrame, key: str, order: list[str], bits: str = "phash_bits") -> DataFrame:
    """10 for the first hashed frame, else a tenth of its distance in bits over 0.64 to the
    hashed frame before it, at most 10; 5 for a frame without a hash."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(bits, ignorenulls=True).over(w)
    far = F.least(hamming(F.col(bits), before) / 6.4, F.lit(10.0))
    return frames.withColumn("_b", before).withColumn("novelty_score", F.when(F.col(bits).isNull(), 5.0).when(F.col("_b").isNull(), 10.0).otherwise(far)).drop("_b")


def stability(frames: DataFrame, key: str, order: list[str], bits: str = "phash_bits") -> DataFrame:
    """5 less a third of the mean distance to the neighbours that have a hash, at least 0; 2.5 without any."""
    w = Window.partitionBy(key).orderBy(*order)
    ds = F.filter(F.array(hamming(F.col(bits), F.lag(bits).over(w)), hamming(F.col(bits), F.lead(bits).over(w))), lambda d: d.isNotNull())
    mean = F.aggregate("_ds", F.lit(0), lambda a, d: a + d) / F.size("_ds")
    out = frames.withColumn("_ds", ds)
    return out.withColumn("stability_score", F.when(F.col(bits).isNull() | (F.size("_ds") == 0), 2.5).otherwise(F.greatest(F.lit(0.0), 5.0 - mean / 3))).drop("_ds")


def info_score(frames: DataFrame) -> DataFrame:
    return frames.withColumn("info_score", F.col("novelty_score") + F.col("anchor_score") + F.col("stability_score"))
