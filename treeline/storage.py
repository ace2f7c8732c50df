"""Folders that executors share, and sizes of what is exchanged and broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; where unset (tests), a temporary one of this machine."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="treeline-tables-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT, ignore_errors=True)
    return f"file://{_LOCAL_ROOT}"


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts_for(spark: SparkSession, size: int, part: int = 4 << 20) -> int:
    """Partitions of an exchange of ``size`` bytes of Parquet: the session's number, or more where one would be over ``part``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part))


#: Rows of a table of servers that is sent to every executor; a longer one is exchanged.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows, which are counted, are few."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


#: Rows and bytes of texts or files that a Python worker gets at once.
TEXT_ROWS, TEXT_BYTES = 128, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the length of Arrow batches for this session if it is over ``TEXT_ROWS`` or ``TEXT_BYTES``; plans read it when they run."""
    conf = spark._jsparkSession.sessionState().conf()
    if not 0 < conf.arrowMaxRecordsPerBatch() <= TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    if not 0 < conf.arrowMaxBytesPerBatch() <= TEXT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
