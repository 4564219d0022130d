"""Keyword search over an index of letter triples: texts are read only where a hit may be."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.scalars import contains_keyword

#: Parts of the texts and of the postings, unless said otherwise.
PARTS = 64


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies: texts by part of their key, postings by part of their triple."""

    folder: str
    key: str
    text: str
    parts: int


def triples(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    letters = F.split(F.lower(text), "")
    return F.array_distinct(F.transform(F.arrays_zip(letters.alias("a"), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))).alias("b"), F.slice(letters, 3, F.greatest(F.size(letters) - 2, F.lit(0))).alias("c")), lambda z: F.concat(z["a"], z["b"], z["c"])))


def build_index(texts: DataFrame, key: str, text: str, folder: str, parts: int = PARTS) -> TextIndex:
    """Write the texts, and for each triple the parts and keys that hold it.

    Rows of one ``key`` lie in one part. A null text holds no triple and is never a hit.
    """
    placed = texts.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    placed.repartition(parts, "_part").write.partitionBy("_part").parquet(f"{folder}/texts")
    each = placed.where(F.col(text).isNotNull()).select("_part", key, F.explode(triples(F.col(text))).alias("triple")).where("triple IS NOT NULL").distinct()
    lists = each.groupBy("triple", "_part").agg(F.collect_set(key).alias("keys")).withColumnRenamed("_part", "part")
    lists = lists.withColumn("_shelf", F.pmod(F.xxhash64("triple"), F.lit(parts)).cast("int"))
    lists.repartition(parts, "_shelf").sortWithinPartitions("_shelf", "triple").write.partitionBy("_shelf").parquet(f"{folder}/postings")
    return TextIndex(folder, key, text, parts)


def search(spark: SparkSession, index: TextIndex, keyword: str) -> DataFrame:
    """The indexed rows whose text contains the keyword in any case of letters.

    The keyword's triples are looked up first: only their shelves are read, and only the parts
    of texts that hold all of them are. Keys in these that lack a triple are left out before
    the texts are compared. A keyword of fewer than three characters reads all texts.
    """
    texts = spark.read.parquet(f"{index.folder}/texts")
    wanted = spark.range(1).select(F.explode(triples(F.lit(keyword))).alias("triple")).where("triple IS NOT NULL").select("triple", F.pmod(F.xxhash64("triple"), F.lit(index.parts)).cast("int").alias("shelf")).collect()
    if not wanted:
        return texts.where(contains_keyword(F.col(index.text), keyword)).drop("_part")
    postings = spark.read.parquet(f"{index.folder}/postings")
    found = postings.where(F.col("_shelf").isin([w.shelf for w in wanted]) & F.col("triple").isin([w.triple for w in wanted]))
    # Keys are shuffled within parts that hold all triples.
    held = found.groupBy("part").agg(F.count_distinct("triple").alias("n")).where(F.col("n") == len(wanted)).select("part")
    parts = [r.part for r in held.collect()]
    keys = found.where(F.col("part").isin(parts)).select(F.explode("keys").alias(index.key), "triple").groupBy(index.key).agg(F.count_distinct("triple").alias("n")).where(F.col("n") == len(wanted)).select(index.key)
    return texts.where(F.col("_part").isin(parts)).join(keys, index.key, "left_semi").where(contains_keyword(F.col(index.text), keyword)).drop("_part")
