"""Changes to a namespace as tables: what is left, and which requests are refused.

Every function takes the requests of one batch and the state before it; requests
of one batch do not depend on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK, MAX_REPLICAS, MAX_STRIPE, MAX_TIER, MIN_STRIPE
from .layout import div
from .namespace import dir_ancestors

#: Statuses and their numbers (fixed values).
STATUS = {"OK": 0, "EPERM": 1, "ENOENT": 2, "EACCES": 13, "EEXIST": 17, "ENOTDIR": 20, "EISDIR": 21, "EINVAL": 22, "ENOSYS": 38, "ENOTEMPTY": 39}


def floor_chunk(offset: Column) -> Column:
    return div(offset, CHUNK) * CHUNK


def prune_head(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks left after requests (fid, upto): those wholly before the chunk of ``upto`` go."""
    r = requests.select("fid", floor_chunk(F.col("upto")).alias("first"))
    return chunks.join(r, "fid", "left").filter("first IS NULL OR offset >= first").drop("first")


def cut(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks left after requests (fid, size): those that begin at or behind the new end go."""
    r = requests.select("fid", F.col("size").alias("end"))
    return chunks.join(r, "fid", "left").filter("end IS NULL OR offset < end").drop("end")


def coalesce_blocks(files: DataFrame, chunks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with status, chunks after): each source's chunks go behind the destination's last one.

    Refused: a file into itself, object-store files, different striping, a striped
    file whose last block is not whole.  A file is in one pair at most.
    """
    ends = chunks.groupBy("fid").agg((F.max("offset") + CHUNK).alias("next"))
    cols = ("num_replicas", "num_stripes", "num_recovery", "stripe_size")
    f = files.select("fid", *cols).join(ends, "fid", "left").withColumn("next", F.coalesce("next", F.lit(0)).cast("long"))
    side = lambda s: f.select(*[F.col(c).alias(f"{s}_{c}") for c in f.columns])
    rows = pairs.join(side("s"), F.col("src") == F.col("s_fid"), "left").join(side("d"), F.col("dst") == F.col("d_fid"), "left")
    differ = F.lit(False)
    for c in cols[1:]:
        differ = differ | (F.col(f"s_{c}") != F.col(f"d_{c}"))
    whole = lambda s: F.col(f"{s}_next") % (CHUNK * F.greatest(F.lit(1).cast("long"), F.col(f"{s}_num_stripes") + F.col(f"{s}_num_recovery"))) == 0
    status = (
        F.when(F.col("s_fid").isNull() | F.col("d_fid").isNull(), "ENOENT")
        .when(F.col("src") == F.col("dst"), "EINVAL")
        .when((F.col("s_num_replicas") == 0) | (F.col("d_num_replicas") == 0), "ENOSYS")
        .when(differ | ~whole("s") | ~whole("d"), "EINVAL")
        .otherwise("OK")
    )
    checked = rows.select("src", "dst", status.alias("status"), F.col("d_next").alias("start"))
    moves = checked.filter("status = 'OK'").select(F.col("src").alias("fid"), "dst", "start")
    moved = chunks.join(moves, "fid", "left")
    after = moved.withColumns({"fid": F.coalesce("dst", "fid"), "offset": F.col("offset") + F.coalesce("start", F.lit(0))}).select(chunks.columns)
    return checked.select("src", "dst", "status"), after


def set_replication(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(fid, copies, status) of requests (fid, copies); object-store files and others do not become each other."""
    rows = requests.join(files.select("fid", "num_replicas"), "fid", "left")
    bad = (F.col("copies") < 0) | (F.col("copies") > MAX_REPLICAS) | ((F.col("copies") == 0) != (F.col("num_replicas") == 0))
    status = F.when(F.col("num_replicas").isNull(), "ENOENT").when(bad, "EINVAL").otherwise("OK")
    return rows.select("fid", F.when(status == "OK", F.col("copies")).otherwise(F.col("num_replicas")).alias("copies"), status.alias("status"))


def rename(fattr: DataFrame, dirs: DataFrame, requests: DataFrame, depth: int | None = None) -> DataFrame:
    """(fid, parent, name, status) of requests (fid, to_parent, to_name, overwrite)."""
    me = fattr.select("fid", F.col("type").alias("t"))
    there = fattr.select(F.col("parent").alias("p2"), F.col("name").alias("n2"), F.col("fid").alias("old"), F.col("type").alias("old_t"))
    above = dir_ancestors(dirs, depth).select(F.col("fid").alias("p3"), F.col("a").alias("over"))
    rows = requests.join(me, "fid", "left").join(dirs.select(F.col("fid").alias("p1")), F.col("to_parent") == F.col("p1"), "left")
    rows = rows.join(there, (F.col("to_parent") == F.col("p2")) & (F.col("to_name") == F.col("n2")), "left")
    rows = rows.join(above, (F.col("to_parent") == F.col("p3")) & (F.col("fid") == F.col("over")), "left")
    status = (
        F.when(F.col("t").isNull(), "ENOENT")
        .when(F.col("p1").isNull(), "ENOTDIR")
        .when(F.col("over").isNotNull(), "EINVAL")
        .when(F.col("old").isNotNull() & ~F.col("overwrite"), "EEXIST")
        .when((F.col("old_t") == "dir") & (F.col("t") == "file"), "EISDIR")
        .otherwise("OK")
    )
    return rows.select("fid", F.col("to_parent").alias("parent"), F.col("to_name").alias("name"), status.alias("status"))


def remove_trees(fattr: DataFrame, dirs: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``fattr`` without the directories of ``roots`` (fid) and everything below."""
    gone = dir_ancestors(dirs, depth).join(roots.select(F.col("fid").alias("a")), "a", "left_semi").select("fid").distinct()
    left = fattr.join(gone, "fid", "left_anti")
    return left.join(gone.withColumnRenamed("fid", "parent"), "parent", "left_anti")


def dumpster(files: DataFrame, removed: DataFrame, cleanup_before: int) -> tuple[DataFrame, DataFrame]:
    """(files left, files to delete now): removed files (fid, us) wait until the cut-off."""
    left = files.join(removed.select("fid"), "fid", "left_anti")
    return left, files.join(removed.filter(F.col("us") < cleanup_before).select("fid"), "fid", "left_semi")


def expunge(names: DataFrame, now: Column, interval_s: int) -> DataFrame:
    """Trash checkpoints (name: yyMMddHHmm, perhaps with a dot and a number) older than the interval."""
    day = F.regexp_extract("name", r"^(\d{10})(\.\d+)?$", 1)
    at = F.unix_timestamp(F.try_to_timestamp(F.concat(F.lit("20"), day), F.lit("yyyyMMddHHmm")))
    return names.filter((day != "") & (at + interval_s <= now))


def stripe_valid(n: Column, m: Column, size: Column) -> Column:
    return (n > 0) & (m >= 0) & (size >= MIN_STRIPE) & (size <= MAX_STRIPE) & (size % MIN_STRIPE == 0) & (F.lit(CHUNK) % F.greatest(F.lit(1), size) == 0)


def create_params(text: Column) -> Column:
    """Copies, stripes, recovery stripes, stripe size, type and tiers of ``R,N,M,S,type,min,max`` or ``S[,min[,max]]``; null if not valid.

    Files are striped for type 2 alone; numbers end at the first other character.
    """
    p = F.split(text, ",")
    at = lambda i, default: F.when(F.size(p) > i, F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.get(p, F.lit(i)), r"^\s*(-?\d+)", 1), F.lit("")), F.lit("S999999999")).cast("long"), F.lit(0))).otherwise(default).cast("long")
    plain = F.coalesce(text, F.lit("")) == ""
    short = F.get(p, F.lit(0)) == "S"
    long = lambda v: F.lit(v).cast("long")
    pick = lambda i, s, d: F.when(plain, long(d)).when(short, s if isinstance(s, Column) else long(s)).otherwise(at(i, d))
    kind = pick(4, 2, 1)
    striped = kind != 1
    copies, low = pick(0, 1, 2), pick(5, at(1, MAX_TIER), MAX_TIER)
    high = pick(6, at(2, MAX_TIER), MAX_TIER)
    n, m, size = (F.when(striped, c).otherwise(long(0)) for c in (pick(1, 6, 0), pick(2, 3, 0), pick(3, 65536, 0)))
    tiers = (low >= 0) & (low <= high) & (high <= MAX_TIER)
    ok = (copies >= 0) & tiers & (~striped | ((kind == 2) & stripe_valid(n, m, size)))
    return F.when(ok, F.struct(copies.alias("copies"), n.alias("stripes"), m.alias("recovery"), size.alias("stripe_size"), low.alias("min_tier"), high.alias("max_tier")))


def workload(spark, levels: int, fan_out: int, files: int) -> DataFrame:
    """(path, type) of a tree with ``fan_out`` directories at each level and ``files`` files in each of the lowest."""
    level = spark.range(1).select(F.lit("").alias("path"))
    out = level.filter("false").select("path", F.lit("dir").alias("type"))
    for _ in range(levels):
        level = level.select(F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1))).alias("i"), "path").select(F.concat("path", F.lit("/dir_"), "i").alias("path"))
        out = out.union(level.select("path", F.lit("dir").alias("type")))
    leaf = level.select(F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("i"), "path").select(F.concat("path", F.lit("/file_"), "i").alias("path"), F.lit("file").alias("type"))
    return out.union(leaf)


def copy_tree(fattr: DataFrame, chunks: DataFrame, inside: DataFrame, top: int, parent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(entries, chunks) of a recursive copy of the entry ``top`` to ``name`` in the directory ``parent``.

    ``inside``: the attributes of ``top`` and of all below it.  Copies get the ids of what they copy, shifted past the
    greatest in use, so that parents and children need no join to find each other; their chunks have no replicas yet.
    """
    shift = lambda df, c: F.broadcast(df.agg((F.coalesce(F.max(c), F.lit(0)) + 1).alias("shift")))  # one row
    is_top = F.col("fid") == top
    new = {
        "parent": F.when(is_top, F.lit(parent).cast("long")).otherwise(F.col("parent") + F.col("shift")),
        "name": F.when(is_top, F.lit(name)).otherwise(F.col("name")), "fid": F.col("fid") + F.col("shift"),
    }
    by = shift(fattr, "fid")
    entries = inside.crossJoin(by).select(*[new.get(c, F.col(c)).alias(c) for c in fattr.columns])
    of = chunks.join(inside.filter("type = 'file'").select("fid"), "fid", "left_semi").crossJoin(by)
    ids = shift(chunks, "chunk_id").withColumnRenamed("shift", "by")
    moved = {"fid": F.col("fid") + F.col("shift"), "chunk_id": F.col("chunk_id") + F.col("by")}
    return entries, of.crossJoin(ids).select(*[moved.get(c, F.col(c)).alias(c) for c in chunks.columns])
