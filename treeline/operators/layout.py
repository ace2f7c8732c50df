"""Where the bytes of files are: chunks, replicas and stripes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def block_index(offset: Column, n: Column, m: Column) -> Column:
    """The block of a chunk: N + M chunks if striped, else one."""
    return div(div(offset, CHUNK), F.when(n > 0, n + m).otherwise(F.lit(1).cast("long")))


def stripe_position(pos: Column, n: Column, m: Column, size: Column) -> dict[str, Column]:
    """Block, stripe and physical position of a logical position in a striped file."""
    block, b = div(pos, n * CHUNK), pos % (n * CHUNK)
    idx = div(b, size) % n
    phys = block * CHUNK * (n + m) + div(b, size * n) * size + idx * CHUNK + b % size
    return {"block": block, "stripe": idx, "physical": phys}


def stripe_chunk_size(idx: Column, block_pos: Column, file_size: Column, n: Column, size: Column) -> Column:
    """Expected length of one chunk of a block; recovery stripes are as long as the first stripe."""
    rest = file_size - block_pos
    idx = F.when(idx < n, idx).otherwise(F.lit(0).cast("long"))
    head = rest % (size * n)
    last = div(head, size)
    part = F.when(idx < last, size).when(idx == last, head % size).otherwise(F.lit(0).cast("long"))
    unknown = (file_size < 0) | (rest <= 0) | (rest >= n * CHUNK)
    return F.when(unknown, F.lit(CHUNK).cast("long")).otherwise(div(rest, size * n) * size + part)


def layout_page(chunks: DataFrame, replicas: DataFrame, fid: int, start: int, most: int) -> DataFrame:
    """The chunks of a file from an offset on with their servers, and whether there are more."""
    rows = chunks.filter((F.col("fid") == fid) & (F.col("offset") >= start)).orderBy("offset").limit(most + 1)
    more = rows.agg((F.count(F.lit(1)) > most).alias("has_more"))
    where = replicas.filter(F.col("fid") == fid).groupBy("chunk_id").agg(F.array_sort(F.collect_list("server_id")).alias("servers"))
    page = rows.orderBy("offset").limit(most).join(where, "chunk_id", "left").crossJoin(F.broadcast(more))  # one row, not a pairing
    return page.select("chunk_id", "offset", "version", F.array_join(F.coalesce("servers", F.array().cast("array<bigint>")), ",").alias("servers"), "has_more")


def last_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("fid").agg(F.max_by("chunk_id", "offset").alias("chunk_id"), F.max("offset").alias("offset"))


def byte_ranges(ranges: DataFrame, chunks: DataFrame, replicas: DataFrame) -> DataFrame:
    """(fid, start, chunk_id, begin, length, server_id) of ranges (fid, start, length), chunk by chunk."""
    end = F.col("start") + F.col("length")
    blocks = F.sequence(div(F.col("start"), CHUNK), div(end - 1, CHUNK))
    parts = ranges.filter("length > 0").withColumn("block", F.explode(blocks))
    begin = F.greatest(F.col("start"), F.col("block") * CHUNK)
    parts = parts.select("fid", "start", "block", begin.alias("begin"), (F.least(end, (F.col("block") + 1) * CHUNK) - begin).alias("length"))
    held = chunks.select("fid", div(F.col("offset"), CHUNK).alias("block"), "chunk_id").join(replicas.select("chunk_id", "server_id"), "chunk_id")
    return parts.join(held, ["fid", "block"]).drop("block")


def effective_size(files: DataFrame, chunks: DataFrame, replicas: DataFrame) -> DataFrame:
    """(fid, size): files of unknown (negative) size end where the largest copy of their last chunk does.

    Everything goes by file id: a file's last chunk meets the few sums of its copies, so tables that are partitioned by file stay where they are.
    """
    held = replicas.groupBy("fid", "chunk_id").agg(F.max(F.when(F.col("size") > 0, F.col("size"))).alias("held")).withColumnRenamed("chunk_id", "c")
    found = last_chunks(chunks).join(held, "fid", "left").withColumn("held", F.when(F.col("chunk_id") == F.col("c"), F.col("held")))
    ends = found.groupBy("fid").agg((F.max("offset") + F.coalesce(F.max("held"), F.lit(CHUNK))).alias("found"))
    return files.join(ends, "fid", "left").select("fid", F.when(F.col("size") >= 0, F.col("size")).otherwise(F.coalesce("found", F.lit(0))).cast("long").alias("size"))


def object_blocks(files: DataFrame) -> DataFrame:
    """One pseudo chunk for each 64 MiB of an object-store file."""
    return files.filter("size > 0").select("fid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(CHUNK).cast("long"))).alias("offset"))


def sparse_read(blocks: DataFrame, files: DataFrame, unit: int) -> DataFrame:
    """(fid, block, data): every block of ``unit`` bytes below a file's size; holes are zeros."""
    all_ = files.filter("size > 0").select("fid", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("size") - 1, unit))).alias("block"))
    return all_.join(blocks, ["fid", "block"], "left").withColumn("data", F.coalesce("data", F.unhex(F.lit("00" * unit))))


def merged_ranges(files: DataFrame) -> DataFrame:
    """(parent, fid, at, size): where each file begins when a directory's files are joined into one, in the order of their names.

    The sizes alone are moved; with them every file is copied to its place on its own.
    """
    w = Window.partitionBy("parent").orderBy("name", "fid").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("parent", "fid", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long").alias("at"), "size")
