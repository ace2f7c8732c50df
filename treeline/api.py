"""A namespace with the verbs of the command line, on DataFrames."""

from __future__ import annotations

import errno
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import MAX_NAME, MAX_TIER, ROOT
from .functions import text as T
from .lens import Lens
from .operators import layout, mutations, namespace, replay
from .sources import checkpoint_text


class Namespace:
    """``fattr``, ``chunks`` and ``replicas`` as in ``lens``; every method returns a lazy DataFrame unless it says otherwise.

    Changes go to a log beside the snapshot, which is replayed onto it once, however long it has become; ``compact`` ends it.
    """

    def __init__(self, fattr: DataFrame, chunks: DataFrame, replicas: DataFrame, depth: int | None = None, log: tuple = ()):
        self.snapshot, self.log, self.chunks, self.replicas, self.depth = fattr, log, chunks, replicas, None if log else depth
        if log:
            fattr = replay.replay(fattr, fattr.sparkSession.createDataFrame(list(log), replay.OPS))
        self.fattr = fattr
        self.dirs = fattr.filter("type = 'dir'").select("fid", "parent", "name")

    @classmethod
    def of(cls, lens: Lens) -> Namespace:
        return cls(lens.fattr, lens.chunks, lens.replicas, lens.DEPTH)

    def paths(self) -> DataFrame:
        return namespace.all_paths(self.fattr, self.dirs, self.depth)

    def lookup(self, path: str) -> DataFrame:
        """One equi-join for each part of the path."""
        at = self.fattr.filter(F.col("fid") == ROOT)
        for part in [p for p in path.split("/") if p]:
            above = at.select(F.col("fid").alias("above"))
            at = self.fattr.filter((F.col("name") == part) & (F.col("fid") != ROOT)).join(F.broadcast(above), F.col("parent") == F.col("above"), "left_semi")
        return at.filter("type = 'dir'") if path.endswith("/") and path.strip("/") else at

    def exists(self, path: str) -> bool:
        return not self.lookup(path).isEmpty()

    def is_dir(self, path: str) -> bool:
        return not self.lookup(path).filter("type = 'dir'").isEmpty()

    def is_file(self, path: str) -> bool:
        return not self.lookup(path).filter("type = 'file'").isEmpty()

    def readdir(self, path: str) -> DataFrame:
        """Names in order."""
        return self.readdirplus(path).select("name").orderBy("name")

    def readdirplus(self, path: str) -> DataFrame:
        above = self.lookup(path).select(F.col("fid").alias("above"))
        return self.fattr.filter(F.col("fid") != ROOT).join(F.broadcast(above), F.col("parent") == F.col("above"), "left_semi")

    def glob(self, pattern: str) -> DataFrame:
        return self.paths().filter(F.col("path").rlike(T.glob_regex(pattern)))

    def stat(self, path: str, fmt: str = "%y") -> DataFrame:
        return self.lookup(path).select(T.stat_format(fmt).alias("stat"))

    def du(self, path: str) -> DataFrame:
        sums = namespace.rollup(self.fattr, self.dirs, self.depth).select("fid", "bytes")
        bytes_ = F.when(F.col("type") == "dir", F.coalesce("bytes", F.lit(0))).otherwise(F.col("size"))
        return self.readdirplus(path).join(sums, "fid", "left").select("name", bytes_.alias("bytes"))

    def dus(self, path: str) -> DataFrame:
        return self.count(path).select("bytes")

    def count(self, path: str) -> DataFrame:
        sums = namespace.rollup(self.fattr, self.dirs, self.depth)
        return self.lookup(path).select("fid").join(sums, "fid").select("fid", (F.col("dirs") + 1).alias("dirs"), "files", "bytes")

    def chunk_locations(self, path: str) -> DataFrame:
        fid = self.lookup(path).select("fid")
        return self.chunks.join(F.broadcast(fid), "fid", "left_semi").join(self.replicas.select("chunk_id", "k", "server_id"), "chunk_id", "left")

    def data_location(self, path: str, start: int, length: int) -> DataFrame:
        r = self.lookup(path).select("fid", F.lit(start).cast("long").alias("start"), F.lit(length).cast("long").alias("length"))
        return layout.byte_ranges(r, self.chunks, self.replicas)

    def data_verify(self) -> DataFrame:
        """Copies that differ from the first of their chunk."""
        from .operators.integrity import mismatches

        return mismatches(self.replicas)

    # Changes.  Each gives the namespace after it; a request that cannot be met is an ``OSError``.

    def _one(self, path: str):
        rows = self.lookup(path).select("fid", "parent", "name", "type").take(1)
        if not rows:
            raise OSError(errno.ENOENT, os.strerror(errno.ENOENT), path)
        return rows[0]

    def _place(self, path: str) -> tuple[int, str]:
        """The directory and name that a new entry would have."""
        head, _, name = path.rstrip("/").rpartition("/")
        if not name or name in (".", "..") or len(name.encode()) > MAX_NAME:
            raise OSError(errno.EINVAL, os.strerror(errno.EINVAL), path)
        above = self._one(head or "/")
        if above.type != "dir":
            raise OSError(errno.ENOTDIR, os.strerror(errno.ENOTDIR), path)
        return above.fid, name

    def apply(self, ops: DataFrame) -> Namespace:
        """After a log (``replay.OPS``) of what has succeeded."""
        return Namespace(replay.replay(self.fattr, ops), self.chunks, self.replicas, None)

    def _apply(self, op: str, fid: int, us: int = 0, **values) -> Namespace:
        row = {"seq": len(self.log), "us": us, "op": op, "fid": fid} | values
        entry = tuple(row.get(part.split()[0]) for part in replay.OPS.split(", "))
        return Namespace(self.snapshot, self.chunks, self.replicas, self.depth, (*self.log, entry))

    def _make(self, op: str, path: str, mode: int, uid: int, gid: int, us: int) -> Namespace:
        parent, name = self._place(path)
        if self.exists(path):
            raise OSError(errno.EEXIST, os.strerror(errno.EEXIST), path)
        fid = self.fattr.agg(F.max("fid")).first()[0] + 1
        return self._apply(op, fid, us, parent=parent, name=name, mode=mode, uid=uid, gid=gid)

    def mkdir(self, path: str, mode: int = 0o755, uid: int = 0, gid: int = 0, us: int = 0) -> Namespace:
        return self._make("mkdir", path, mode, uid, gid, us)

    def mkdirs(self, path: str, mode: int = 0o755) -> Namespace:
        """Makes what is missing on the way."""
        ns, at = self, ""
        for part in [p for p in path.split("/") if p]:
            at += f"/{part}"
            ns = ns if ns.exists(at) else ns.mkdir(at, mode)
        return ns

    def create(self, path: str, mode: int = 0o644, uid: int = 0, gid: int = 0, us: int = 0) -> Namespace:
        return self._make("create", path, mode, uid, gid, us)

    def touchz(self, path: str, us: int = 0) -> Namespace:
        """Makes an empty file, or sets the time of one that is empty."""
        if not self.exists(path):
            return self.create(path, us=us)
        if self.lookup(path).filter("type <> 'file' OR size <> 0").take(1):
            raise OSError(errno.EINVAL, os.strerror(errno.EINVAL), path)
        return self._apply("setmtime", self._one(path).fid, us)

    def symlink(self, path: str, us: int = 0) -> Namespace:
        return self._make("symlink", path, 0o777, 0, 0, us)

    def remove(self, path: str) -> Namespace:
        at = self._one(path)
        if at.type == "dir":
            raise OSError(errno.EISDIR, os.strerror(errno.EISDIR), path)
        return self._apply("remove", at.fid)

    def rmdir(self, path: str) -> Namespace:
        at = self._one(path)
        if at.type != "dir" or at.fid == ROOT:
            bad = errno.EPERM if at.fid == ROOT else errno.ENOTDIR
            raise OSError(bad, os.strerror(bad), path)
        if self.fattr.filter(F.col("parent") == at.fid).take(1):
            raise OSError(errno.ENOTEMPTY, os.strerror(errno.ENOTEMPTY), path)
        return self._apply("rmdir", at.fid)

    def rename(self, path: str, to: str, overwrite: bool = True) -> Namespace:
        at, (parent, name) = self._one(path), self._place(to)
        there = self.lookup(to).select("fid", "type").take(1)
        inside = f"{to.rstrip('/')}/".startswith(f"{path.rstrip('/')}/") and at.fid != (there[0].fid if there else None)
        bad = errno.EINVAL if inside or at.fid == ROOT else 0
        if not bad and there and there[0].fid != at.fid:
            full = there[0].type == "dir" and self.fattr.filter(F.col("parent") == there[0].fid).take(1)
            bad = errno.EEXIST if not overwrite else errno.EISDIR if there[0].type == "dir" and at.type != "dir" else errno.ENOTEMPTY if full else 0
        if bad:
            raise OSError(bad, os.strerror(bad), to)
        return self._apply("rename", at.fid, parent=parent, name=name)

    def truncate(self, path: str, size: int) -> Namespace:
        return self._apply("truncate", self._one(path).fid, size=size)

    def chown(self, path: str, uid: int, gid: int) -> Namespace:
        return self._apply("chown", self._one(path).fid, uid=uid, gid=gid)

    def below(self, path: str) -> DataFrame:
        """The entry and everything below it: what a recursive change is applied to."""
        at = self._one(path)
        dirs = namespace.dir_ancestors(self.dirs, self.depth).filter(F.col("a") == at.fid).select(F.col("fid").alias("parent"))
        inside = self.fattr.filter(F.col("fid") != F.col("parent")).join(dirs, "parent", "left_semi")
        return inside.select(self.fattr.columns).union(self.lookup(path).select(self.fattr.columns)).dropDuplicates(["fid"])

    def set_tiers(self, path: str, low: int, high: int) -> Namespace:
        """The storage tiers of an entry's files, below it too."""
        if not 0 <= low <= high <= MAX_TIER:
            raise OSError(errno.EINVAL, os.strerror(errno.EINVAL), path)
        mine = self.below(path).filter("type = 'file'").select("fid", F.lit(True).alias("mine"))
        tier = lambda c, v: F.when(F.col("mine"), F.lit(v).cast("long")).otherwise(F.col(c)).alias(c)
        new = {"min_tier": tier("min_tier", low), "max_tier": tier("max_tier", high)}
        fattr = self.fattr.join(mine, "fid", "left").select(*[new.get(c, F.col(c)) for c in self.fattr.columns])
        return Namespace(fattr, self.chunks, self.replicas, self.depth)

    def copy(self, path: str, to: str) -> Namespace:
        """A recursive copy; into ``to`` if that is a directory, as the command line has it.  Chunks of the copy have no replicas yet."""
        if self.is_dir(to):
            to = f"{to.rstrip('/')}/{path.rstrip('/').rpartition('/')[2]}"
        at, (parent, name) = self._one(path), self._place(to)
        bad = errno.EEXIST if self.exists(to) else errno.EINVAL if at.fid == ROOT or f"{to}/".startswith(f"{path.rstrip('/')}/") else 0
        if bad:
            raise OSError(bad, os.strerror(bad), to)
        entries, chunks = mutations.copy_tree(self.fattr, self.chunks, self.below(path), at.fid, parent, name)
        return Namespace(self.fattr.union(entries), self.chunks.union(chunks), self.replicas)

    def compact(self, ops: DataFrame, path: str, seq: int) -> None:
        """Replays a log and writes the state as a new checkpoint."""
        checkpoint_text.write(self.apply(ops).fattr, self.chunks, path, seq)

    def chmod(self, change: str) -> DataFrame:
        """The attributes with changed modes."""
        return self.fattr.withColumn("mode", T.chmod(F.col("mode"), F.col("type") == "dir", change))
