"""Mixing sources to target weights with thresholds on a hash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.support import WORD_PATTERN, clean_text, cut, join_checked, written

#: Weights of the sources by code point, repeating; their share of all sizes, and how often a
#: document may be taken.
WEIGHTS, SHARE_PERCENT, REPEATS = (5, 2, 1), 150, 2
#: Bits of a document's hash, and bits by which a histogram tells hashes apart.
HASH_BITS, LEVEL_BITS = 60, 12


def hashed_order(id_col: Column, text: Column, seed: str = "mix") -> Column:
    """A number below 2**60 by the id and text of a document, alike in all runs."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(clean_text(text).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def target_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """``sizes``, a row for each source with its ``source_size``, with the ``target`` of each.

    Sources by code point, null last, take the weights in turn. Resharing by weight what
    exceeds a source's limit ends where every source has its limit or the same amount for each unit of
    weight. In the order of limit over weight the limited sources come first, so running sums
    tell that amount without rounds: it is that of the first source which stays within its limit
    when those before it are at theirs. One task sorts the rows of the sources (not of documents).
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * repeats)
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    everything, before = Window.partitionBy(), Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Budgets are held as hundredths, so the share is a whole number.
    left = F.sum("source_size").over(everything) * share_percent - 100 * F.coalesce(F.sum("limit").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumns({"_left": left.cast("double"), "_heavy": 100.0 * heavy, "_rank": F.row_number().over(Window.orderBy(*order))})
    within = F.col("limit") * F.col("_heavy") >= F.col("weight") * F.col("_left")
    rows = rows.withColumn("_level", F.min(F.when(within, F.struct("_rank", "_left", "_heavy"))).over(everything))
    amount = F.col("weight") * F.col("_level._left") / F.col("_level._heavy")
    return rows.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(amount, F.col("limit").cast("double")))).select(*sizes.columns, "target")


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, turn, threshold, n_tied, n_taken) of budgets between nothing and all of a key's sizes.

    ``sized`` holds (key, h, size) for each row, ``budgets`` (key, turn, budget). Of a key's rows
    those with ``h`` below the threshold add up to the budget, and ``n_taken`` of the ``n_tied``
    rows at the threshold itself bring the sum as near to it as their sizes allow. Thresholds of one key
    are nested: a greater budget takes all that a smaller one does.

    Sizes are summed up by key and bucket of the hash. Only the bucket in which a budget ends is
    looked into further, 12 bits of the hash at a time, until it holds one hash. So nothing is
    sorted but the buckets of each key, 4096 at most.
    """
    marks = cut(budgets.select("key", "turn", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix")))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = sized.select("key", "h", "size", F.shiftright("h", shift + LEVEL_BITS).alias("prefix"))
        wanted = marks.select("key", "prefix").distinct()
        met = join_checked(inside, wanted, ["key", "prefix"], "left_semi")
        buckets = met.groupBy("key", "prefix", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("s").over(Window.partitionBy("key", "turn").orderBy("bucket"))
        placed = marks.select("key", "turn", "left", "prefix").join(buckets, ["key", "prefix"]).withColumn("_upto", upto)
        ends = placed.where((F.col("_upto") - F.col("s") <= F.col("left")) & (F.col("left") < F.col("_upto")))
        marks = cut(ends.select("key", "turn", (F.col("left") - (F.col("_upto") - F.col("s"))).alias("left"), F.col("bucket").alias("prefix"), "s", "n", "low", "high"))
        if marks.where("low < high").isEmpty():
            break
    taken = F.floor(F.col("left") * F.col("n") / F.col("s") + 0.5).cast("long")
    return marks.select("key", "turn", F.col("low").alias("threshold"), F.col("n").alias("n_tied"), F.least(taken, F.col("n")).alias("n_taken"))


def _numbered(tied: DataFrame) -> DataFrame:
    """Rows with equal key and hash with their ``number`` from 1, part by part of the written table."""
    rows = tied.withColumn("_part", F.shiftright("row", 33))
    counts = rows.groupBy("key", "h", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("key", "h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("key", "h", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("key", "h", "_part").orderBy("row")
    numbered = rows.withColumn("_row", F.row_number().over(within)).join(base, ["key", "h", "_part"])
    return numbered.withColumn("number", F.col("_base") + F.col("_row")).select(*tied.columns, "number")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of all documents.

    ``size`` counts the words of the text (null: none). A source's ``target`` (:func:`target_sizes`)
    is a budget for each time that its documents are taken: a whole source at a time, then what is left.
    A budget that ends within a source takes the documents whose hash lies below its
    threshold (:func:`hash_thresholds`), so what a source gives differs from its target by at most
    half the size of the document at the threshold. ``taken`` is the size as often as it is taken.

    Choice goes by id and text alone, so all runs agree; rows alike in id, text and source are
    taken as often as the budget asks, whichever of them it is. A null source is a source of its
    own, the last. Documents without words are of size 0 and add nothing. An empty table gives no
    rows. Texts are read once; all later passes read a table of a few numbers for each document.
    """
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sized = written(documents.select(
        "doc_id", "source", source.alias("key"),
        F.regexp_count(clean_text(F.col("text")), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        hashed_order(F.col("doc_id"), F.col("text")).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    ))
    sources = cut(target_sizes(cut(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))), weights, share_percent, repeats))
    turns = sources.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("budget", F.col("target") - F.col("turn") * F.col("source_size"))
    partial = hash_thresholds(sized, turns.where((F.col("budget") > 0) & (F.col("budget") < F.col("source_size"))))
    whole = turns.groupBy("key").agg(F.count_if((F.col("budget") >= F.col("source_size")) & (F.col("source_size") > 0)).alias("whole"))
    ends = partial.groupBy("key").agg(F.collect_list(F.struct("threshold", "n_taken")).alias("ends"))
    plan = cut(sources.select("key", "source_size", "target").join(whole, "key").join(ends, "key", "left"))

    split = partial.where((F.col("n_taken") > 0) & (F.col("n_taken") < F.col("n_tied"))).select("key", F.col("threshold").alias("h")).distinct()
    split = cut(split)
    rows = sized.withColumn("number", F.lit(1).cast("long"))
    if not split.isEmpty():
        tied = join_checked(sized, split, ["key", "h"], "left_semi")
        rows = join_checked(sized, split, ["key", "h"], "left_anti").withColumn("number", F.lit(1).cast("long")).unionByName(_numbered(tied))
    planned = join_checked(rows, plan, ["key"], "inner")
    inside = F.filter(F.coalesce("ends", F.array().cast(plan.schema["ends"].dataType)), lambda e: (F.col("h") < e["threshold"]) | ((F.col("h") == e["threshold"]) & (F.col("number") <= e["n_taken"])))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.size(inside))).alias("taken"), "source")
