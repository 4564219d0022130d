"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows may be broadcast (about 60 MB at 60 bytes).
BROADCAST_ROWS = 1_000_000

#: A word is a maximal run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: The temporary folder of sessions on one machine.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share; it goes when the driver's JVM ends.

    Where the setting is unset, a session on one machine gets a temporary folder, which goes
    when Python ends; on a cluster that is an error, as executors would not see each other's parts.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("base")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL["base"] = tempfile.mkdtemp(prefix="timeloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    out = f"{base.rstrip('/')}/timeloom-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of :func:`shared_dir` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(df: DataFrame, size: str = "6m") -> DataFrame:
    """Let Spark hand Python workers batches of at most ``size`` (or one row, if that is longer).

    This sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch``; a limit other than
    the default of 64 MB is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) in (None, "-1", "64MB", "67108864", "67108864b"):
        df.sparkSession.conf.set(key, size)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back (columnar, so later reads prune columns)."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, small: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialised table, broadcast only if it has at most ``rows`` rows.

    Beyond that Spark shuffles both sides, and adaptive execution splits skewed keys.
    """
    small = cut(small)
    if small.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(small), on, how)
    return left.join(small, on, how)


def join_lists_checked(documents: DataFrame, lists: DataFrame, key: str, entries: int = 250_000) -> DataFrame:
    """Documents with their lists; the lists are broadcast only if they hold at most ``entries`` numbers or structs in all.

    Beyond that the documents without a list go first, by their ids alone, and the others are shuffled.
    """
    lists = cut(lists)
    held = [F.coalesce(F.size(c), F.lit(0)) for c, kind in lists.dtypes if kind.startswith("array")]
    if (lists.select(F.sum(sum(F.greatest(h, F.lit(0)) for h in held))).first()[0] or 0) <= entries:
        return documents.join(F.broadcast(lists), key)
    return join_checked(documents, lists.select(key), [key], "left_semi").join(lists, key)


def crc_of_id(col: Column) -> Column:
    """Unsigned crc32 of the decimal text of an id, by which rows are held out."""
    return F.crc32(col.cast("string").cast("binary"))


def clean_text(col: Column) -> Column:
    """The text, or the empty string for null."""
    return F.coalesce(col, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(table: DataFrame) -> DataFrame:
    """A scan's rows, dealt out evenly if the scan has fewer splits than the cluster has cores.

    Such a table is small or one unsplittable file; any other is read as it lies.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
