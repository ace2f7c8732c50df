"""Queries on changes to the namespace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Namespace
from ..lens import Lens
from ..operators import mutations as mu
from .catalog import query


@query("""SELECT c.fid, count(*) AS chunks, min("offset") AS first FROM chunks c JOIN files f ON f.fid = c.fid
WHERE c.fid % 7 <> 0 OR "offset" >= f.size // 2 // 67108864 * 67108864 GROUP BY c.fid""")
def prune_from_head(x: Lens):
    r = x.files.filter("fid % 7 = 0").select("fid", F.expr("size div 2").alias("upto"))
    return mu.prune_head(x.chunks, r).groupBy("fid").agg(F.count(F.lit(1)).alias("chunks"), F.min("offset").alias("first"))


@query("""SELECT c.fid, count(*) AS chunks, max("offset") AS last FROM chunks c JOIN files f ON f.fid = c.fid WHERE c.fid % 7 <> 0 OR "offset" < f.size // 2 GROUP BY c.fid""")
def truncate_chunks(x: Lens):
    r = x.files.filter("fid % 7 = 0").select("fid", F.expr("size div 2").alias("size"))
    return mu.cut(x.chunks, r).groupBy("fid").agg(F.count(F.lit(1)).alias("chunks"), F.max("offset").alias("last"))


PAIRS_SQL = """, n AS (SELECT f.fid, num_replicas, num_stripes, num_recovery, stripe_size, coalesce(max("offset") + 67108864, 0) AS nx FROM files f LEFT JOIN chunks c ON c.fid = f.fid GROUP BY ALL),
w AS (SELECT *, nx % (67108864 * greatest(1, num_stripes + num_recovery)) = 0 AS whole FROM n),
p AS (SELECT s.fid AS src, s.fid + 1 AS dst, CASE WHEN d.fid IS NULL THEN 'ENOENT' WHEN s.num_stripes <> d.num_stripes OR NOT s.whole OR NOT d.whole THEN 'EINVAL' ELSE 'OK' END AS status, d.nx AS start
FROM w s LEFT JOIN w d ON d.fid = s.fid + 1 WHERE s.fid % 4 = 0)
"""


def _pairs(x: Lens):
    return x.files.filter("fid % 4 = 0").select(F.col("fid").alias("src"), (F.col("fid") + 1).alias("dst"))


@query(PAIRS_SQL + "SELECT src, dst, status FROM p")
def coalesce_status(x: Lens):
    return mu.coalesce_blocks(x.files, x.chunks, _pairs(x))[0]


@query(PAIRS_SQL + """SELECT coalesce(p.dst, c.fid) AS fid, c.chunk_id, c."offset" + coalesce(p.start, 0) AS "offset" FROM chunks c LEFT JOIN p ON p.src = c.fid AND status = 'OK'""")
def coalesce_chunks(x: Lens):
    return mu.coalesce_blocks(x.files, x.chunks, _pairs(x))[1].select("fid", "chunk_id", "offset")


@query("SELECT fid, CASE WHEN fid % 70 BETWEEN 1 AND 64 THEN fid % 70 ELSE num_replicas END AS copies, CASE WHEN fid % 70 BETWEEN 1 AND 64 THEN 'OK' ELSE 'EINVAL' END AS status FROM files")
def set_replication(x: Lens):
    return mu.set_replication(x.files, x.files.select("fid", (F.col("fid") % 70).alias("copies")))


@query("""SELECT n.fid, 10 + n.fid % 7 AS parent, n.name, CASE WHEN n.fid % 7 > 4 THEN 'ENOTDIR' WHEN n.parent = 10 + n.fid % 7 THEN 'EEXIST' ELSE 'OK' END AS status FROM dirs n WHERE n.fid BETWEEN 100 AND 999
UNION ALL SELECT r.fid, n.fid, 'x', CASE WHEN n.parent = r.fid THEN 'EINVAL' ELSE 'OK' END FROM dirs r JOIN dirs n ON n.fid BETWEEN 100 AND 999 AND n.fid % 5 = r.fid % 5 WHERE r.fid BETWEEN 10 AND 99""")
def rename_status(x: Lens):
    """Nations move to regions, and regions below nations, some of them their own."""
    d = x.dirs
    up = d.filter("fid BETWEEN 100 AND 999").select("fid", (F.col("fid") % 7 + 10).alias("to_parent"), F.col("name").alias("to_name"), F.lit(False).alias("overwrite"))
    n = d.filter("fid BETWEEN 100 AND 999").select(F.col("fid").alias("to_parent"), (F.col("fid") % 5).alias("five"))
    down = d.filter("fid BETWEEN 10 AND 99").select("fid", (F.col("fid") % 5).alias("five")).join(n, "five")
    down = down.select("fid", "to_parent", F.lit("x").alias("to_name"), F.lit(False).alias("overwrite"))
    return mu.rename(x.fattr, d, up.union(down), x.DEPTH)


@query(""", gone AS (SELECT fid FROM anc WHERE a IN (103, 104, 11) UNION SELECT fid FROM dirs WHERE fid IN (103, 104, 11))
SELECT fid, type FROM fattr WHERE fid NOT IN (SELECT fid FROM gone)""")
def remove_recursive(x: Lens):
    roots = x.spark.createDataFrame([(103,), (104,), (11,)], "fid long")
    return mu.remove_trees(x.fattr, x.dirs, roots, x.DEPTH).select("fid", "type")


@query(""", t AS (SELECT * FROM fattr WHERE fid = 12 OR fid IN (SELECT fid FROM anc WHERE a = 12)), k AS (SELECT max(fid) + 1 AS k FROM fattr), c AS (SELECT max(chunk_id) + 1 AS c FROM chunks),
n AS (SELECT fid, count(*) AS chunks, min(chunk_id + c) AS first_chunk FROM chunks, c GROUP BY fid)
SELECT t.fid + k AS fid, CASE WHEN t.fid = 12 THEN 10 ELSE parent + k END AS parent, CASE WHEN t.fid = 12 THEN 'copy' ELSE name END AS name, type, size, coalesce(chunks, 0) AS chunks, first_chunk
FROM t CROSS JOIN k LEFT JOIN n ON n.fid = t.fid""")
def copy_tree(x: Lens):
    """What a recursive copy of one region into another makes, with the chunks of each file."""
    entries, chunks = mu.copy_tree(x.fattr, x.chunks, Namespace.of(x).below("/ASIA"), 12, 10, "copy")
    of = chunks.groupBy("fid").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_id").alias("first_chunk"))
    return entries.join(of, "fid", "left").select("fid", "parent", "name", "type", "size", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "first_chunk")


@query(""", r AS (SELECT fid, max(us) AS us FROM oplog WHERE op = 'remove' AND committed GROUP BY fid), t AS (SELECT quantile_disc(us, 0.5) AS m FROM oplog)
SELECT fid FROM files WHERE fid IN (SELECT fid FROM r WHERE us < 1704800000000000)""")
def dumpster_cleanup(x: Lens):
    removed = x.oplog.filter("op = 'remove' AND committed").groupBy("fid").agg(F.max("us").alias("us"))
    return mu.dumpster(x.files, removed, 1_704_800_000_000_000)[1].select("fid")


@query("""SELECT name FROM (SELECT DISTINCT strftime(date_trunc('hour', make_timestamp(us)), '%y%m%d%H%M') || CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE 'x' END AS name, us // 3600000000 AS h, seq % 3 AS k FROM oplog)
WHERE k < 2 AND h * 3600 + 3600 <= 1704800000""")
def trash_expunge(x: Lens):
    hour = F.expr("us div 3600000000 * 3600")
    stamp = F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01")) + F.make_dt_interval(secs=hour), "yyMMddHHmm")
    names = x.oplog.select(F.concat(stamp, F.expr("CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE 'x' END")).alias("name")).distinct()
    return mu.expunge(names, F.lit(1_704_800_000), 3600)


@query("""SELECT * FROM (VALUES ('', 2, 0, 0, 0, 15, 15), ('S', 1, 6, 3, 65536, 15, 15), ('S,3,5', 1, 6, 3, 65536, 3, 5), ('3', 3, 0, 0, 0, 15, 15), ('1,4,3,131072,2,2,9', 1, 4, 3, 131072, 2, 9), ('2,4,3,65536,1', 2, 0, 0, 0, 15, 15),
('-1', NULL, NULL, NULL, NULL, NULL, NULL), ('1,6,3,5000,2', NULL, NULL, NULL, NULL, NULL, NULL), ('1,6,3,65536,2,9,2', NULL, NULL, NULL, NULL, NULL, NULL)) t(params, copies, stripes, recovery, stripe_size, min_tier, max_tier)""", tables=False)
def create_params(x: Lens):
    texts = ["", "S", "S,3,5", "3", "1,4,3,131072,2,2,9", "2,4,3,65536,1", "-1", "1,6,3,5000,2", "1,6,3,65536,2,9,2"]
    rows = x.spark.createDataFrame([(t,) for t in texts], "params string").withColumn("p", mu.create_params(F.col("params")))
    return rows.select("params", *[F.col(f"p.{c}").cast("int").alias(c) for c in ("copies", "stripes", "recovery", "stripe_size", "min_tier", "max_tier")])


@query("SELECT s AS stripe_size, s BETWEEN 4096 AND 67108864 AND s % 4096 = 0 AND 67108864 % s = 0 AS valid FROM (SELECT (1 + i * 97 % 33) * 2048 AS s FROM range(200) t(i))", tables=False)
def stripe_valid(x: Lens):
    size = F.expr("(1 + id * 97 % 33) * 2048")
    return x.spark.range(200).select(size.alias("stripe_size"), mu.stripe_valid(F.lit(6), F.lit(3), size).alias("valid"))


@query("""SELECT * FROM (VALUES ('OK', 0), ('EPERM', 1), ('ENOENT', 2), ('EACCES', 13), ('EEXIST', 17), ('ENOTDIR', 20), ('EISDIR', 21), ('EINVAL', 22), ('ENOSYS', 38), ('ENOTEMPTY', 39)) t(status, number)""", tables=False)
def status_names(x: Lens):
    return x.spark.createDataFrame(list(mu.STATUS.items()), "status string, number int")


@query("""SELECT type, count(*) AS n FROM (SELECT 'dir' AS type FROM range(5 + 25 + 125) UNION ALL SELECT 'file' FROM range(125 * 4)) GROUP BY type""", tables=False)
def workload_tree(x: Lens):
    return mu.workload(x.spark, 3, 5, 4).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
