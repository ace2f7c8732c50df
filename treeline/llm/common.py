"""Helpers shared by the operators: intermediate tables and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker.  Texts can be long, so the
#: default of 10,000 rows would let one batch outgrow a worker's memory.
BATCH_ROWS = 256

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; where unset (tests), a temporary one."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="treeline-")
        import shutil

        atexit.register(shutil.rmtree, _LOCAL_ROOT, ignore_errors=True)
    return f"file://{_LOCAL_ROOT}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/treeline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at
    files that outlive any executor, and nothing upstream is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeline_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._treeline_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch length for this session if it is longer than ``BATCH_ROWS``.

    It stays lowered: a plan reads the setting when it runs, which is after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run):
    """``run`` for ``mapInArrow``, after which a worker gives its free memory back.

    Workers are used again by later tasks; what one has freed would otherwise stay
    with its allocators and count beside the next task's memory.
    """

    def inner(batches):
        for n, out in enumerate(run(batches)):
            yield out
            if n % 64 == 63:
                pa.default_memory_pool().release_unused()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return inner


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z in lower case, everything else untouched.

    ``lower`` would fold other letters too, but is many times faster where there are none.
    """
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def is_under(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows
