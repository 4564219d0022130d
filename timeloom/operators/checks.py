"""Checks of what was written: code against frames, claims against transcripts, terms, and pass marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.scalars import strip
from timeloom.operators.models import Provider, chat
from timeloom.operators.ranges import range_join
from timeloom.storage import join_checked


def code_in_frames(blocks: DataFrame, frames: DataFrame, key: str, block_id: str, *, code: str = "code", at: str = "timestamp", detail: str = "detail") -> DataFrame:
    """(key, block_id, verified): whether a frame in the block's time range [start, end) shows its code.

    The code counts without white space around it; a block without code, or whose range holds
    no frame, is not verified.
    """
    ranges = blocks.select(key, block_id, F.col("start").alias("_s"), F.col("end").alias("_e"), strip(F.col(code)).alias("_code"))
    shown = frames.where(F.col(detail).isNotNull()).select(key, F.col(at).alias("_at"), F.col(detail).alias("_detail"))
    hits = range_join(shown, ranges, key, "_at", "_s", "_e").where((F.col("_code") != "") & F.contains("_detail", "_code"))
    found = hits.select(key, block_id).distinct().withColumn("verified", F.lit(True))
    return blocks.select(key, block_id).join(found, [key, block_id], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def claims_held(claims: DataFrame, make: Callable[[], Provider], *, claim: str = "claim", transcript: str = "transcript", yes: str = "yes", max_tokens: int = 16) -> DataFrame:
    """The claims with ``supported``: whether a model's reply to claim and transcript begins with ``yes``, in any case."""
    prompt = F.concat(F.lit("Claim: "), claim, F.lit("\nTranscript: "), transcript)
    calls = claims.withColumns({"model": F.lit("verifier"), "prompt": prompt})
    replied = chat(calls, make, max_tokens=max_tokens)
    return replied.withColumn("supported", F.lower(F.coalesce("reply", F.lit(""))).startswith(yes.lower())).drop("model", "prompt", "reply")


def missing_terms(documents: DataFrame, terms: DataFrame, key: str, text: str = "text", term: str = "term") -> DataFrame:
    """(key, term) of one-word terms of a key that none of its texts holds, in any case.

    Words that no key asks for go before anything is shuffled, if the distinct terms are few enough to be sent around.
    """
    wanted = terms.select(key, term).distinct().withColumn("_t", F.lower(term))
    words = documents.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")).alias("_t"))
    asked = join_checked(words, wanted.select("_t").distinct(), ["_t"], "left_semi").distinct()
    return wanted.join(asked, [key, "_t"], "left_anti").select(key, term)


def pass_marks(rows: DataFrame, metrics: dict[str, tuple[Column, float, bool]]) -> DataFrame:
    """(metric, value, target, passed), a row for each named aggregate.

    A metric is an aggregate, its target, and whether the value has to reach the target (else it
    must not exceed it). Without rows a value is null and not passed.
    """
    values = rows.agg(*(c.cast("double").alias(n) for n, (c, _, _) in metrics.items()))
    lines = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(float(t)).alias("target"), F.coalesce(F.col(n) >= t if least else F.col(n) <= t, F.lit(False)).alias("passed")) for n, (_, t, least) in metrics.items()]
    return values.select(F.explode(F.array(*lines)).alias("m")).select("m.*")


def defaults_for_rejected(calls: DataFrame, defaults: dict[str, object], verdict: str = "verdict") -> DataFrame:
    """The calls with the named columns set to their defaults wherever the call was not admitted."""
    return calls.withColumns({c: F.when(F.col(verdict) == "admitted", F.col(c)).otherwise(F.lit(v).cast(calls.schema[c].dataType)) for c, v in defaults.items()})


def transcript_instead(meta: DataFrame, transcripts: DataFrame, failures: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, document) where an outline could not be made: the title, the reason and the transcript as it is."""
    rows = failures.join(meta.select(key, "title"), key, "left").join(transcripts.select(key, "transcript"), key, "left")
    parts = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n["), "reason", F.lit("]\n\n"), F.coalesce("transcript", F.lit("")))
    return rows.select(key, parts.alias("document"))
