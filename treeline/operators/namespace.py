"""Paths, listings, permissions and roll-ups of a directory tree.

``fattr``: fid, parent, name, type ('dir' or 'file'), attributes.  The root is
its own parent.  Hierarchies are expanded level by level with equi-joins on
directories alone; files are aggregated by parent before anything climbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_NAME, ROOT
from ..functions.text import bit


def dir_ancestors(dirs: DataFrame, depth: int | None = None) -> DataFrame:
    """(fid, a): each directory with itself and everything above it.

    One join for each level; without ``depth``, until a level is empty.
    """
    up = dirs.filter(F.col("fid") != ROOT).select("fid", F.col("parent").alias("a"))
    step = up.select(F.col("fid").alias("f2"), F.col("a").alias("next"))
    level, out, n = up, dirs.select("fid", F.col("fid").alias("a")).union(up), 1
    while (n < depth) if depth else not level.isEmpty():
        level = level.join(step, F.col("a") == F.col("f2")).select("fid", F.col("next").alias("a"))
        out, n = out.union(level), n + 1
    return out


def paths(dirs: DataFrame, depth: int | None = None) -> DataFrame:
    """(fid, path) of directories, from the root down."""
    root = dirs.filter(F.col("fid") == ROOT).select("fid", F.lit("").alias("path"))
    rest = dirs.filter(F.col("fid") != ROOT).select("fid", "parent", "name")
    level, out, n = root, root, 1
    while (n < depth) if depth else not level.isEmpty():
        level = rest.join(level.withColumnRenamed("fid", "above"), F.col("parent") == F.col("above")).select("fid", F.concat("path", F.lit("/"), "name").alias("path"))
        out, n = out.union(level), n + 1
    return out.select("fid", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"))


def all_paths(fattr: DataFrame, dirs: DataFrame, depth: int | None = None) -> DataFrame:
    """``fattr`` with ``path``."""
    above = paths(dirs, depth).select(F.col("fid").alias("above"), F.when(F.col("path") == "/", "").otherwise(F.col("path")).alias("head"))
    path = F.when(F.col("fid") == ROOT, "/").otherwise(F.concat("head", F.lit("/"), "name"))
    return fattr.join(above, F.col("parent") == F.col("above")).withColumn("path", path).drop("above", "head")


def rollup(fattr: DataFrame, dirs: DataFrame, depth: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """(fid, bytes, files, dirs, ...): everything below each directory, itself not counted."""
    sums = {"bytes": F.greatest(F.lit(0).cast("long"), F.col("size")), "files": F.lit(1).cast("long")} | (extra or {})
    own = fattr.filter("type = 'file'").groupBy("parent").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    per_dir = dirs.select("fid", (F.col("fid") != ROOT).cast("long").alias("self")).join(own, F.col("fid") == F.col("parent"), "left")
    climbed = dir_ancestors(dirs, depth).join(per_dir, "fid")
    n_dirs = F.sum("self")
    out = climbed.groupBy(F.col("a").alias("fid")).agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in sums], n_dirs.alias("below"))
    return out.withColumn("dirs", (F.col("below") - (F.col("fid") != ROOT).cast("long")).cast("long")).drop("below")


def rollup_deltas(changes: DataFrame, dirs: DataFrame, depth: int | None = None) -> DataFrame:
    """(fid, d_bytes, d_files): changes (parent, d_bytes, d_files) added up for every directory above."""
    per_dir = changes.groupBy("parent").agg(F.sum("d_bytes").alias("d_bytes"), F.sum("d_files").alias("d_files"))
    climbed = dir_ancestors(dirs, depth).join(per_dir, F.col("fid") == F.col("parent"))
    return climbed.groupBy(F.col("a").alias("fid")).agg(F.sum("d_bytes").cast("long").alias("d_bytes"), F.sum("d_files").cast("long").alias("d_files"))


def page(entries: DataFrame, dir_fid: int, after: str | None, n: int) -> DataFrame:
    """The next ``n`` names of a directory in order, and whether there are more."""
    rows = entries.filter((F.col("parent") == dir_fid) & (F.col("fid") != F.col("parent")))
    rows = (rows.filter(F.col("name") > after) if after is not None else rows).orderBy("name").limit(n + 1)
    more = rows.agg((F.count(F.lit(1)) > n).alias("has_more"))
    return rows.orderBy("name").limit(n).crossJoin(F.broadcast(more))  # one row, not a pairing


def allowed(want: int, uid: Column, euid: Column, gid_match: Column, mode: Column) -> Column:
    """Owner, else group, else others; the super-user may do everything."""
    given = F.when(uid == euid, F.shiftright(mode, 6)).when(gid_match, F.shiftright(mode, 3)).otherwise(mode)
    return (euid == 0) | bit(given, want)


def can_access(fattr: DataFrame, requests: DataFrame, user_group: DataFrame, want: int) -> DataFrame:
    """(fid, euid, allowed) of requests (fid, euid, egid): what user ``euid``, now in group ``egid``, may do with a file."""
    member = user_group.select(F.col("uid").alias("euid"), "gid", F.lit(True).alias("member")).distinct()
    rows = requests.join(fattr.select("fid", "uid", "gid", "mode"), "fid").join(member, ["euid", "gid"], "left")
    group = (F.col("gid") == F.col("egid")) | F.coalesce("member", F.lit(False))
    return rows.select("fid", "euid", allowed(want, F.col("uid"), F.col("euid"), group, F.col("mode")).alias("allowed"))


def may_delete(requests: DataFrame, fattr: DataFrame) -> DataFrame:
    """(fid, euid, allowed) of requests (fid, euid): in a sticky directory only its owner, an entry's owner and the super-user delete."""
    above = fattr.select(F.col("fid").alias("parent"), F.col("mode").alias("d_mode"), F.col("uid").alias("d_uid"))
    rows = requests.join(fattr.select("fid", "parent", "uid"), "fid").join(above, "parent")
    sticky = F.col("d_mode").bitwiseAND(0o1000) != 0
    return rows.select("fid", "euid", (~sticky | F.col("euid").isin(0) | (F.col("euid") == F.col("uid")) | (F.col("euid") == F.col("d_uid"))).alias("allowed"))


def valid_name(name: Column) -> Column:
    """A name of one part: not empty, no dots alone, no slash or line break, not too long."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike("[/\n\r]") & (F.octet_length(name) <= MAX_NAME), F.lit(False))


def summary_counts(tier_low: int = 0, tier_high: int = 15, cutoff_us: int | None = None) -> dict[str, Column]:
    """Conditional sums of a listing summary: chunks, empty and abandoned files."""
    no_bytes, chunks = F.col("size") == 0, F.col("chunk_count") > 0
    old = F.lit(True) if cutoff_us is None else F.col("mtime") < cutoff_us
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return {"chunks": F.col("chunk_count"), "empty": one(no_bytes & ~chunks), "abandoned": one(no_bytes & chunks & old)}


def tier_overlap(low: int, high: int) -> Column:
    return (F.col("max_tier") >= low) & (F.col("min_tier") <= high)
