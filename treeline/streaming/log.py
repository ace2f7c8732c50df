"""The transaction log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEDUP_S
from ..storage import remove, small


def hourly(ops: DataFrame) -> DataFrame:
    """(hour, op, n) of a stream or table with us and op."""
    return ops.groupBy(F.call_function("div", F.col("us"), F.lit(3_600_000_000)).alias("hour"), "op").agg(F.count(F.lit(1)).alias("n"))


def dedup(requests: DataFrame, seconds: int = DEDUP_S) -> DataFrame:
    """First request of each (uid, rid) within the window; state is dropped behind the watermark."""
    at = requests.withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{seconds} seconds")
    return at.dropDuplicatesWithinWatermark(["uid", "rid"]).drop("at")


class CommitQueue:
    """Entries (log, kind, seq, op, fid, arg, us) of a stream that wait for a commit at or above them in their log.

    Between batches the last commit of each log and the entries that wait are tables in the checkpoint folder, each
    with its batch's number: a batch that comes again starts from those of the batch before it.  Nothing holds a log.
    """

    columns = ("log", "seq", "op", "fid", "arg", "us")

    def __init__(self, entries: DataFrame):
        self.entries = entries

    def sink(self, folder: str, foreach):
        """For ``foreachBatch``: ``foreach`` gets what a batch releases, in the order of log and number."""

        def run(df: DataFrame, batch: int) -> None:
            spark = df.sparkSession
            at = lambda name, n: f"{folder}/{name}-{n}"
            tops = df.filter("kind = 'c'").groupBy("log").agg(F.max("seq").alias("top"))
            rows = df.filter("NOT kind <=> 'c'").select(*self.columns)
            if batch > 0:
                tops = tops.union(spark.read.parquet(at("tops", batch - 1))).groupBy("log").agg(F.max("top").alias("top"))
                rows = rows.union(spark.read.parquet(at("waiting", batch - 1)))
            tops.write.mode("overwrite").parquet(at("tops", batch))
            tops = spark.read.parquet(at("tops", batch)).select(F.col("log").alias("of"), "top")
            rows = rows.join(small(tops), F.col("log").eqNullSafe(F.col("of")), "left").withColumn("done", F.col("seq") <= F.coalesce("top", F.lit(-1)))
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows._jdf.rdd().getNumPartitions())
            done = rows.filter("done").select(*self.columns)
            foreach(done.repartitionByRange(n, "log", "seq").sortWithinPartitions("log", "seq"), batch)
            rows.filter("NOT done").select(*self.columns).write.mode("overwrite").parquet(at("waiting", batch))
            for name in ("tops", "waiting"):
                remove(spark, at(name, batch - 2))

        return run


def commit_queue(entries: DataFrame) -> CommitQueue:
    """(log, seq, op, fid, arg, us) of entries (log, kind, seq, ...), each when a commit at or above it has come; for ``run_to_end``."""
    return CommitQueue(entries)


def append_sink(path: str):
    """For ``foreachBatch``: a batch that comes again replaces its own part, so each record is there once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def run_to_end(stream: DataFrame | CommitQueue, checkpoint: str, mode: str = "append", **sink) -> None:
    """Process what is there and stop; ``sink``: foreach=function of (table, batch)."""
    foreach = sink["foreach"]
    if isinstance(stream, CommitQueue):
        stream, foreach = stream.entries, stream.sink(f"{checkpoint}/queue", foreach)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(foreach).trigger(availableNow=True).start()
    q.awaitTermination()
