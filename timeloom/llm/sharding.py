"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.support import clean_text

#: The multiplier of the method's 64-bit generator, cut into 32, 16 and 16 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _MID, _LOW = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
_M32, _M16 = 0xFFFFFFFF, 0xFFFF

#: Parts into which the rows of a shard are dealt while slots are numbered.
SLOT_PARTS = 1024


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator, modulo 2**64, on two unsigned halves held in longs.

    ANSI mode rejects a product beyond 63 bits, so the product is put together from parts
    that fit.
    """
    mid = lo * _MID
    low = lo * _LOW + 1 + F.shiftleft(mid.bitwiseAND(_M16), 16)
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(mid, 16)
    up = hi * _LOW + F.shiftleft((hi * _MID).bitwiseAND(_M16), 16) + (lo * _HIGH).bitwiseAND(_M32) + carry
    return up.bitwiseAND(_M32), low.bitwiseAND(_M32)


def _halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(_M32)


def jump_shard(key: Column, n_shards: int) -> Column:
    """Struct of ``shard`` (of ``n_shards``) and ``grown_shard`` (of one more) for a 64-bit key.

    The places that a key jumps to increase and do not depend on the number of shards, so one
    walk gives both: the last place below ``n_shards``, and ``n_shards`` itself if hit. A null
    key counts as 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    hi, lo = _halves(key)

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        draw = F.shiftrightunsigned(hi, 1)
        to = F.floor((s["to"] + 1).cast("double") * (F.lit(2147483648.0) / (draw + 1).cast("double")))
        return F.when(s["to"] >= n_shards, s).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), s["to"].alias("at"), to.alias("to")))

    zero = F.lit(0).cast("long")
    begin = F.struct(hi.alias("hi"), lo.alias("lo"), zero.alias("at"), zero.alias("to"))
    end = F.aggregate(F.array_repeat(F.lit(0), n_shards), begin, step)
    return F.transform(
        F.array(end),
        lambda s: F.struct(s["at"].cast("int").alias("shard"), F.when(s["to"] == n_shards, n_shards).otherwise(s["at"]).cast("int").alias("grown_shard")),
    )[0]


def slot_part(key: Column, parts: int = SLOT_PARTS) -> Column:
    """A number from 0 to ``parts`` - 1 by the low bits of a key's first draw."""
    hi, lo = _halves(key)
    hi, _ = _next(hi, lo)
    return F.shiftrightunsigned(hi, 1) % parts


def assign_shards(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """The rows with ``shard`` and ``grown_shard``; every column is kept.

    Equal keys share a shard, whatever else the rows hold. Null keys count as key 0. Columns
    called ``shard`` or ``grown_shard`` are replaced.
    """
    return df.withColumn("shard", F.lit(None)).withColumn("grown_shard", F.lit(None)).withColumn("_jump", jump_shard(F.col(key), n_shards)).withColumns(
        {"shard": F.col("_jump.shard"), "grown_shard": F.col("_jump.grown_shard")}
    ).drop("_jump")


def number_slots(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Gapless ``slot`` numbers from 0 within each ``shard``.

    A shard may hold a large part of all rows, so its rows are dealt into ``SLOT_PARTS`` parts
    by the key's first draw, and rows of one key, of which there may be as many, by the other columns of ``order``, whole
    numbers. Rows alike in all of these share a part. Rows are numbered within their part, in ``order``, and begin where
    the counts of the shard's parts before it end. The table of counts has a row for each
    shard and part at most, which bounds what is broadcast.
    """
    dealt = df.withColumn("_part", sum((F.col(c) for c in order if c != key), slot_part(F.col(key))) % SLOT_PARTS)
    counts = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard", "_part").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(within))
    return numbered.join(F.broadcast(base), ["shard", "_part"]).withColumn("slot", F.col("_base") + F.col("_row") - 1).drop("_part", "_row", "_base")


def shard_documents(documents: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and digest of each document.

    Law ``key``: only the id and the number of shards decide, and one more shard takes rows
    only into itself. A null text has 16 bytes and the checksum of no bytes; an empty table
    gives no rows; repeated rows get a slot each.
    """
    text = clean_text(F.col(text_col))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = assign_shards(rows, "doc_id", n_shards)
    return number_slots(sharded, "doc_id", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
