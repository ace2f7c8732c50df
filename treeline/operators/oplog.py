"""The transaction log: commits, gaps, repeated requests, and folding it into state.

Operations are deterministic functions of state, so a batch fold keeps, for each
file, what its last committed operations leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def committed(ahead: DataFrame, commits: DataFrame) -> DataFrame:
    """Entries written ahead up to the greatest committed sequence, in order of it."""
    top = commits.agg(F.max("seq").alias("top"))
    return ahead.crossJoin(F.broadcast(top)).filter("seq <= top").drop("top")  # one row, not a pairing


def segment_gaps(segments: DataFrame) -> DataFrame:
    """(segment, start, expected, problem) of segments (segment, start, end) that do not go on where the one before ended.

    Only one row for each segment of the log is ordered here, never its entries.
    """
    w = Window.orderBy("segment")
    expected = F.lag("end").over(w) + 1
    rows = segments.withColumn("expected", expected).filter(F.col("expected").isNotNull() & (F.col("start") != F.col("expected")))
    return rows.select("segment", "start", "expected", F.when(F.col("start") > F.col("expected"), "gap").otherwise("overlap").alias("problem"))


def dedup_requests(requests: DataFrame, window_us: int, key: tuple[str, ...] = ("op", "uid", "rid")) -> DataFrame:
    """Requests that are no repeats: of each key the first, then each that comes later than the window after the last one kept.

    A repeat does not renew the window, which runs from the time of the recorded request.  Requests without a user
    or with no or a negative id are not tracked and stay.  A partition's rows are read in order of key and time, and
    only the last key and time are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, since = None, 0
        for b in batches:
            fresh = []
            keys = zip(*(b.column(c).to_pylist() for c in key), strict=True)
            for k, us, uid, rid in zip(keys, *(b.column(c).to_pylist() for c in ("us", "uid", "rid")), strict=True):
                tracked = uid is not None and rid is not None and rid >= 0
                new = not tracked or k != last or us - since > window_us
                if new and tracked:
                    last, since = k, us
                fresh.append(new)
            yield b.filter(pa.array(fresh, pa.bool_()))

    return requests.repartition(*key).sortWithinPartitions(*key, "us", "seq").mapInArrow(run, requests.schema)


def fold(ops: DataFrame) -> DataFrame:
    """(fid, exists, size, mtime, n): the state of each file after its operations (seq, op, fid, arg, us).

    create makes an empty file anew, truncate sets the size, setmtime the time,
    remove ends it; operations before the last create or remove do not matter.
    """
    last = lambda op, value: F.max_by(F.when(F.col("op") == op, F.col(value)), F.when(F.col("op") == op, F.col("seq")))
    at = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    rows = ops.groupBy("fid").agg(
        at("create").alias("created"), at("remove").alias("removed"), at("truncate").alias("cut"), at("setmtime").alias("touched"),
        last("truncate", "arg").alias("cut_to"), last("setmtime", "us").alias("touched_us"), last("create", "us").alias("created_us"), F.count(F.lit(1)).alias("n"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(-1))
    exists = zero("created") >= zero("removed")
    base = F.greatest(zero("created"), zero("removed"))
    size = F.when(exists & (zero("cut") > base), F.col("cut_to")).otherwise(0).cast("long")
    mtime = F.when(zero("touched") > base, F.col("touched_us")).otherwise(F.coalesce("created_us", F.lit(0))).cast("long")
    return rows.select("fid", exists.alias("exists"), size.alias("size"), F.when(exists, mtime).alias("mtime"), "n")


def prune(manifest: DataFrame, keep: int) -> DataFrame:
    """Rows of (name, seq) beyond the ``keep`` newest of each name."""
    r = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))
    return manifest.withColumn("r", r).filter(F.col("r") > keep).drop("r")


def converge(appends: DataFrame) -> DataFrame:
    """(chunk_id, size, copies): after failed appends all copies keep what the shortest has."""
    return appends.groupBy("chunk_id").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def block_checksums(lines: DataFrame, block: str = "block") -> DataFrame:
    """(block, adler) of log lines (block, seq, line): the checksum of a block's lines in order, each with its line end.

    A block is what is written to the log at once, so its lines fit in memory.
    """
    from ..functions.checksums import adler32

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    rows = lines.groupBy(block).agg(text.alias("text"))
    return rows.select(block, adler32(F.encode("text", "UTF-8")).alias("adler"))
