"""Checkpoint text: one line for each entry, a digest of the whole at the end.

The text is for interchange: its digest covers all lines in order, so one task
writes and one verifies it.  Snapshots to compute on are Parquet.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hex(c: Column) -> Column:
    """Lower case; a minus sign goes before the digits."""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lower(F.hex(F.abs(c))))


def _number(c: Column) -> Column:
    digits = F.conv(F.replace(c, F.lit("-"), F.lit("")), 16, 10).cast("long")
    return F.when(c.startswith("-"), -digits).otherwise(digits)


def _time(us: Column) -> Column:
    return F.concat(_hex(F.call_function("div", us, F.lit(1000000))), F.lit("/"), _hex(us % 1000000))


def _fields(tag: str, **parts: Column) -> Column:
    out = [F.lit(tag)]
    for key, value in parts.items():
        out += [F.lit(f"/{key[0]}/"), value]
    return F.concat(*out)


def dentry_lines(fattr: DataFrame) -> DataFrame:
    return fattr.select(F.lit(1).alias("part"), F.col("fid").alias("k1"), F.lit(0).cast("long").alias("k2"), _fields("d", n=F.col("name"), i=_hex(F.col("fid")), p=_hex(F.col("parent"))).alias("line"))


def fattr_lines(fattr: DataFrame) -> DataFrame:
    t = _time(F.col("mtime"))
    head = F.concat(F.lit("a/"), F.col("type"), _fields("", i=_hex(F.col("fid")), c1=_hex(F.col("chunk_count")), r=_hex(F.col("num_replicas")), m=t, c2=t, C=t, e=_hex(F.col("size"))))
    stripes = F.when(F.col("num_stripes") > 0, _fields("", s=F.lit("1"), N=_hex(F.col("num_stripes")), R=_hex(F.col("num_recovery")), S=_hex(F.col("stripe_size")))).otherwise("")
    tiers = F.when(F.col("min_tier") < 15, _fields("", t=_hex(F.col("min_tier")), T=_hex(F.col("max_tier")))).otherwise("")
    owner = _fields("", u=_hex(F.col("uid")), g=_hex(F.col("gid")), M=_hex(F.col("mode")))
    return fattr.select(F.lit(2).alias("part"), F.col("fid").alias("k1"), F.lit(0).cast("long").alias("k2"), F.concat(head, stripes, owner, tiers).alias("line"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    line = _fields("c", i=_hex(F.col("fid")), c=_hex(F.col("chunk_id")), o=_hex(F.col("offset")), v=_hex(F.col("version")))
    return chunks.select(F.lit(3).alias("part"), F.col("fid").alias("k1"), F.col("offset").alias("k2"), F.concat(line, F.lit("/s/")).alias("line"))


def write(fattr: DataFrame, chunks: DataFrame, path: str, seq: int, time: str = "1970-01-01T00:00:00.000000Z") -> None:
    spark = fattr.sparkSession
    head = [f"checkpoint/{seq}/0/0/0", "checksum/last-line", "version/1", "filesysteminfo/fsid/1/crtime/0/0", "fid/0", "chunkId/0", f"time/{time}", "shortnames/1", "setintbase/16", f"log/log.{seq}", ""]
    first = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(head)], "part int, k1 long, k2 long, line string")
    last = spark.createDataFrame([(4, i, 0, x) for i, x in enumerate(["worm/0", f"time/{time}"])], "part int, k1 long, k2 long, line string")
    lines = first.union(dentry_lines(fattr)).union(fattr_lines(fattr)).union(chunk_lines(chunks)).union(last)

    def run(batches):
        md5 = hashlib.md5()
        for b in batches:
            for x in b.column(0).to_pylist():
                md5.update(x.encode() + b"\n")
            yield b.rename_columns(["value"])
        yield pa.record_batch([pa.array([f"checksum/{md5.hexdigest()}"])], ["value"])

    ordered = lines.repartition(1).sortWithinPartitions("part", "k1", "k2").select("line")
    ordered.mapInArrow(run, "value string").write.text(path)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, ok): whether the last line is the digest of those before it."""

    def run(batches):
        for b in batches:
            ok = []
            for content in b.column(1).to_pylist():
                at = content.rstrip(b"\n").rfind(b"\n") + 1
                ok.append(content[at:].strip() == b"checksum/" + hashlib.md5(content[:at]).hexdigest().encode())
            yield pa.record_batch([b.column(0), pa.array(ok, pa.bool_())], ["file", "ok"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, "file string, ok boolean")


_N = "(-?[0-9a-f]+)"
_FATTR = rf"^a/(file|dir|empty)/i/{_N}/c/{_N}/r/{_N}/m/{_N}/{_N}/c/{_N}/{_N}/C/{_N}/{_N}/e/{_N}(?:/s/{_N}/N/{_N}/R/{_N}/S/{_N})?/u/{_N}/g/{_N}/M/{_N}(?:/t/{_N}/T/{_N})?"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Directory entries (fid, parent, name), attributes and chunks of a checkpoint."""
    t = spark.read.text(path)
    v = F.col("value")
    g = lambda pattern, i: F.regexp_extract(v, pattern, i)
    d = rf"^d/n/(.*)/i/{_N}/p/{_N}$"
    dentry = t.filter(v.rlike(d)).select(_number(g(d, 2)).alias("fid"), _number(g(d, 3)).alias("parent"), g(d, 1).alias("name"))
    n = lambda i, default=0: F.when(g(_FATTR, i) == "", F.lit(default).cast("long")).otherwise(_number(g(_FATTR, i)))
    names = {"fid": 2, "chunk_count": 3, "num_replicas": 4, "size": 11, "num_stripes": 13, "num_recovery": 14, "stripe_size": 15, "uid": 16, "gid": 17, "mode": 18}
    fattr = t.filter(v.rlike(_FATTR)).select(g(_FATTR, 1).alias("type"), *[n(i).alias(k) for k, i in names.items()], (n(5) * 1000000 + n(6)).alias("mtime"), n(19, 15).alias("min_tier"), n(20, 15).alias("max_tier"))
    c = rf"^c/i/{_N}/c/{_N}/o/{_N}/v/{_N}/s/"
    chunks = t.filter(v.rlike(c)).select(*[_number(g(c, i + 1)).alias(k) for i, k in enumerate(("fid", "chunk_id", "offset", "version"))])
    return dentry, fattr, chunks
