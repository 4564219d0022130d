"""Tables between the steps of a query: checkpoints, written tables, and joins with sides of a checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows may be broadcast (about 60 MB at 60 bytes).
BROADCAST_ROWS = 1_000_000

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
