"""Replaying a log onto a snapshot: the namespace, chunks and groups.

A log holds what has succeeded, in order of ``seq``.  So the state after it needs
no row-by-row loop: the last making or removal of an entry is its base, and each
attribute is what its last writer after the base has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What makes an entry, and the type it gets; what ends one.
BIRTHS = {"create": "file", "mkdir": "dir", "symlink": "link"}
DEATHS = ("remove", "rmdir")
OPS = "seq long, us long, op string, fid long, parent long, name string, mode long, uid long, gid long, size long"


def _last(when, *values: str):
    return F.max(F.when(when, F.struct("seq", *values)))


def replay(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """``snapshot`` (fid, parent, name, type, mode, uid, gid, size, mtime, ...) after ``ops`` (``OPS``).

    An entry that another one is put on is gone (a rename that overwrites), wherever
    the other goes later.  Further columns of new entries are null.  The snapshot is
    joined by file id and then by name with the log's rows alone.
    """
    op = F.col("op")
    birth, link = op.isin(*BIRTHS), op.isin(*BIRTHS, "rename")
    state = ops.groupBy("fid").agg(
        _last(birth | op.isin(*DEATHS), "op", "us", "mode", "uid", "gid").alias("base"), _last(link, "parent", "name").alias("link"),
        _last(op.isin("truncate", "setsize"), "size").alias("cut"), _last(op.isin("setmtime"), "us").alias("touch"),
        _last(op == "chmod", "mode").alias("chmod"), _last(op == "chown", "uid", "gid").alias("chown"),
    )
    old = {c: F.col(f"old.{c}") for c in snapshot.columns if c != "fid"}
    both = snapshot.select("fid", F.struct(*old_columns(snapshot)).alias("old")).join(state, "fid", "full_outer")
    born = F.col("base.op").isin(*BIRTHS)
    lives = F.coalesce(born, F.col("base").isNull() & F.col("old").isNotNull())
    since = F.coalesce("base.seq", F.lit(-1))
    kept = lambda c, new: F.when(F.coalesce(born, F.lit(False)), new).otherwise(old[c])
    wrote = lambda w, c, rest: F.when(F.col(f"{w}.seq") > since, F.col(f"{w}.{c}")).otherwise(rest)
    linked = F.coalesce(F.col("link.seq") >= since, F.lit(False))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in BIRTHS.items() for x in pair]), F.col("base.op"))
    new = {
        "parent": F.when(linked, F.col("link.parent")).otherwise(old["parent"]), "name": F.when(linked, F.col("link.name")).otherwise(old["name"]),
        "type": kept("type", kind), "size": wrote("cut", "size", kept("size", F.lit(0).cast("long"))), "mtime": wrote("touch", "us", kept("mtime", F.col("base.us"))),
        "mode": wrote("chmod", "mode", kept("mode", F.col("base.mode"))), "uid": wrote("chown", "uid", kept("uid", F.col("base.uid"))), "gid": wrote("chown", "gid", kept("gid", F.col("base.gid"))),
    }
    columns = [new.get(c, kept(c, F.lit(None)) if c != "fid" else F.col("fid")).alias(c) for c in snapshot.columns]
    after = both.filter(lives).select(*columns, F.when(linked, F.col("link.seq")).otherwise(-1).alias("put"))
    top = ops.filter(link).groupBy(F.col("parent").alias("p2"), F.col("name").alias("n2")).agg(F.max("seq").alias("top"))
    at = (F.col("parent") == F.col("p2")) & (F.col("name") == F.col("n2"))
    return after.join(top, at, "left").filter(F.col("top").isNull() | (F.col("top") <= F.col("put"))).select(snapshot.columns)


def old_columns(df: DataFrame) -> list:
    return [F.col(c) for c in df.columns if c != "fid"]


def replay_chunks(chunks: DataFrame, ops: DataFrame) -> DataFrame:
    """``chunks`` (fid, offset, chunk_id, version, size, stable) after ``ops`` (seq, op, fid, offset, chunk_id, version, size).

    allocate puts a chunk at an offset of a file, or gives the one that is there a
    new version; it is not stable until make-stable has set its size.
    """
    at = ["fid", "offset"]
    state = ops.groupBy(*at).agg(_last(F.col("op") == "allocate", "chunk_id", "version").alias("a"), _last(F.col("op") == "make_stable", "size").alias("s"))
    old = chunks.select(*at, *[F.col(c).alias(f"old_{c}") for c in ("chunk_id", "version", "size", "stable")])
    both = old.join(state, at, "full_outer").filter("old_chunk_id IS NOT NULL OR a IS NOT NULL")
    settled = F.coalesce(F.col("s.seq") > F.coalesce("a.seq", F.lit(-1)), F.lit(False))
    stable = F.when(settled, True).when(F.col("a").isNotNull(), False).otherwise(F.col("old_stable"))
    return both.select(
        *at, F.coalesce("a.chunk_id", "old_chunk_id").alias("chunk_id"), F.coalesce("a.version", "old_version").alias("version"),
        F.when(settled, F.col("s.size")).when(F.col("a").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("old_size")).alias("size"), stable.alias("stable"),
    )


def seeds(ops: DataFrame, chunk_seed: int, roll: int = 64 << 10) -> DataFrame:
    """(fid_seed, chunk_seed): past every id in use, and further by ``roll`` for each rolling of the seeds.

    ``ops``: seq, op, fid, chunk_id.
    """
    rolls = F.sum((F.col("op") == "roll_seeds").cast("long")) * roll
    past = lambda c, least: F.greatest(F.coalesce(F.max(c) + 1, F.lit(0)), F.lit(least).cast("long"))
    return ops.agg((past("fid", 3) + rolls).alias("fid_seed"), (past("chunk_id", chunk_seed) + rolls).alias("chunk_seed"))


def replay_groups(user_group: DataFrame, ops: DataFrame) -> DataFrame:
    """(uid, gid) after ``ops`` (seq, op, uid, gid): add, drop, and clear, which empties a group (uid null)."""
    cleared = ops.filter("op = 'clear'").groupBy("gid").agg(F.max("seq").alias("cleared"))
    last = ops.filter("op <> 'clear'").groupBy("uid", "gid").agg(F.max(F.struct("seq", "op")).alias("x"))
    both = user_group.select("uid", "gid", F.lit(-1).cast("long").alias("was")).join(last, ["uid", "gid"], "full_outer").join(cleared, "gid", "left")
    since = F.coalesce("cleared", F.lit(-2))
    added = (F.col("x.op") == "add") & (F.col("x.seq") > since)
    stays = F.col("was").isNotNull() & (F.col("was") > since) & F.col("x").isNull()
    return both.filter(F.coalesce(added, F.lit(False)) | F.coalesce(stays, F.lit(False))).select("uid", "gid")
