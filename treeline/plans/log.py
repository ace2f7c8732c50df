"""Queries on the transaction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEDUP_S
from ..lens import Lens, micros
from ..operators import namespace as ns
from ..operators import oplog as log
from ..operators import replay as rp
from .catalog import query


@query("SELECT seq, op, fid FROM oplog WHERE seq <= (SELECT max(seq) FROM oplog WHERE committed AND seq % 100 = 0)")
def committed_ops(x: Lens):
    return log.committed(x.oplog, x.oplog.filter("committed AND seq % 100 = 0").select("seq")).select("seq", "op", "fid")


@query(""", s AS (SELECT seq // 100 AS segment, min(seq) AS start, max(seq) AS "end" FROM oplog WHERE committed GROUP BY 1), l AS (SELECT *, lag("end") OVER (ORDER BY segment) + 1 AS expected FROM s)
SELECT segment, start, expected, CASE WHEN start > expected THEN 'gap' ELSE 'overlap' END AS problem FROM l WHERE start <> expected""")
def segment_gaps(x: Lens):
    s = x.oplog.filter("committed").groupBy(F.expr("seq div 100").alias("segment")).agg(F.min("seq").alias("start"), F.max("seq").alias("end"))
    return log.segment_gaps(s)


@query(f""", r AS (SELECT seq, us, uid % 3 AS uid, seq // 40 AS rid FROM oplog),
k AS (SELECT uid, rid, min({{'us': us, 'seq': seq}}) AS m FROM r GROUP BY ALL
  UNION ALL SELECT k.uid, k.rid, min({{'us': r.us, 'seq': r.seq}}) FROM k JOIN r ON r.uid = k.uid AND r.rid = k.rid AND r.us - k.m.us > {DEDUP_S}000000 GROUP BY ALL)
SELECT m.seq AS seq, uid, rid FROM k""")
def dedup_requests(x: Lens):
    """One table for all operations; a request expires at a fixed time after it was recorded, and a repeat does not renew it."""
    r = x.oplog.select("seq", (F.col("uid") % 3).alias("uid"), F.expr("seq div 40").alias("rid"), "us")
    return log.dedup_requests(r, DEDUP_S * 1_000_000, ("uid", "rid")).select("seq", "uid", "rid")


@query(f""", r AS (SELECT seq, us, op, uid % 3 AS uid, seq // 40 AS rid FROM oplog),
k AS (SELECT op, uid, rid, min({{'us': us, 'seq': seq}}) AS m FROM r GROUP BY ALL
  UNION ALL SELECT k.op, k.uid, k.rid, min({{'us': r.us, 'seq': r.seq}}) FROM k JOIN r ON r.op = k.op AND r.uid = k.uid AND r.rid = k.rid AND r.us - k.m.us > {DEDUP_S}000000 GROUP BY ALL)
SELECT m.seq AS seq, op, uid, rid FROM k""")
def dedup_requests_expiring(x: Lens):
    """Each operation has a table of its own, and a request expires at a fixed time after it was recorded."""
    r = x.oplog.select("seq", "op", (F.col("uid") % 3).alias("uid"), F.expr("seq div 40").alias("rid"), "us")
    return log.dedup_requests(r, DEDUP_S * 1_000_000).select("seq", "op", "uid", "rid")


@query(""", o AS (SELECT seq, op, fid % 500 AS fid, arg, us FROM oplog WHERE committed),
b AS (SELECT fid, coalesce(max(seq) FILTER (op = 'create'), -1) AS c, coalesce(max(seq) FILTER (op = 'remove'), -1) AS r, count(*) AS n FROM o GROUP BY fid),
t AS (SELECT o.fid, max_by(arg, seq) AS v FROM o JOIN b USING (fid) WHERE op = 'truncate' AND seq > greatest(c, r) GROUP BY o.fid),
m AS (SELECT o.fid, max_by(us, seq) AS v FROM o JOIN b USING (fid) WHERE op = 'setmtime' AND seq > greatest(c, r) GROUP BY o.fid),
k AS (SELECT fid, max_by(us, seq) AS v FROM o WHERE op = 'create' GROUP BY fid)
SELECT b.fid, c >= r AS exists, CASE WHEN c >= r THEN coalesce(t.v, 0) ELSE 0 END AS size, CASE WHEN c >= r THEN coalesce(m.v, k.v, 0) END AS mtime, n
FROM b LEFT JOIN t USING (fid) LEFT JOIN m USING (fid) LEFT JOIN k USING (fid)""")
def log_fold(x: Lens):
    """Files share 500 ids here, so that operations meet."""
    return log.fold(x.oplog.filter("committed").withColumn("fid", F.col("fid") % 500))


@query("SELECT name, seq FROM (SELECT uid AS name, seq, row_number() OVER (PARTITION BY uid ORDER BY seq DESC) AS r FROM oplog) WHERE r > 3")
def prune_keep_n(x: Lens):
    return log.prune(x.oplog.select(F.col("uid").alias("name"), "seq"), 3)


@query("SELECT chunk_id, min(size - k * 17) AS size, count(*) AS copies FROM replicas GROUP BY chunk_id")
def append_converge(x: Lens):
    return log.converge(x.replicas.withColumn("size", F.col("size") - F.col("k") * 17))


@query(""", l AS (SELECT seq // 100 AS block, string_agg('a/' || seq || '/' || op || chr(10), '' ORDER BY seq) AS t FROM oplog GROUP BY 1),
v AS (SELECT block, len(t) AS n, unnest(range(len(t))) AS i, t FROM l), w AS (SELECT block, n, i, ascii(t[i+1])::BIGINT AS v FROM v)
SELECT block, ((any_value(n) + sum((n - i) * v)) % 65521 * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM w GROUP BY block""")
def log_block_checksums(x: Lens):
    lines = x.oplog.select(F.expr("seq div 100").alias("block"), "seq", F.concat_ws("/", F.lit("a"), "seq", "op").alias("line"))
    return log.block_checksums(lines)


OPS_SQL = """, o AS (SELECT event_id AS seq, epoch_us(ts) AS us, (['create', 'mkdir', 'symlink', 'remove', 'rmdir', 'rename', 'truncate', 'setmtime', 'setsize', 'chmod', 'chown', 'rename'])[event_id % 12 + 1] AS op,
  CASE WHEN event_id % 12 < 3 OR event_id % 5 < 2 THEN 5000000000 + event_id // 7 % 97 ELSE 1000000000 + event_id % (SELECT count(*) FROM orders) END AS fid,
  10 + event_id % 5 AS parent, 'n' || event_id % 300 AS name, event_id % 512 AS mode, event_id % 50 AS uid, event_id % 10 AS gid, event_id * 37 % 100000 AS size FROM events WHERE event_id % 11 <> 0),
b AS (SELECT fid, max(seq) AS s, arg_max(op, seq) AS how FROM o WHERE op IN ('create', 'mkdir', 'symlink', 'remove', 'rmdir') GROUP BY fid),
w AS (SELECT o.*, coalesce(s, -1) AS s FROM o LEFT JOIN b USING (fid)),
st AS (SELECT fid, any_value(s) AS s, arg_max(us, seq) FILTER (seq = s) AS born_us, arg_max(mode, seq) FILTER (seq = s OR (op = 'chmod' AND seq > s)) AS mode,
  arg_max(uid, seq) FILTER (seq = s OR (op = 'chown' AND seq > s)) AS uid, arg_max(gid, seq) FILTER (seq = s OR (op = 'chown' AND seq > s)) AS gid,
  arg_max(size, seq) FILTER (op IN ('truncate', 'setsize') AND seq > s) AS size, arg_max(us, seq) FILTER (op = 'setmtime' AND seq > s) AS mtime,
  max(seq) FILTER (op IN ('create', 'mkdir', 'symlink', 'rename') AND seq >= s) AS put, arg_max(parent, seq) FILTER (op IN ('create', 'mkdir', 'symlink', 'rename') AND seq >= s) AS parent,
  arg_max(name, seq) FILTER (op IN ('create', 'mkdir', 'symlink', 'rename') AND seq >= s) AS name FROM w GROUP BY fid),
top AS (SELECT parent, name, max(seq) AS top FROM o WHERE op IN ('create', 'mkdir', 'symlink', 'rename') GROUP BY ALL),
now AS (SELECT coalesce(f.fid, st.fid) AS fid, coalesce(st.parent, f.parent) AS parent, coalesce(st.name, f.name) AS name,
  CASE how WHEN 'create' THEN 'file' WHEN 'mkdir' THEN 'dir' WHEN 'symlink' THEN 'link' ELSE f.type END AS type, coalesce(st.mode, f.mode) AS mode, coalesce(st.uid, f.uid) AS uid, coalesce(st.gid, f.gid) AS gid,
  coalesce(st.size, CASE WHEN how IS NULL THEN f.size ELSE 0 END) AS size, coalesce(st.mtime, born_us, f.mtime) AS mtime, coalesce(put, -1) AS put
  FROM fattr f FULL JOIN st ON f.fid = st.fid LEFT JOIN b ON b.fid = st.fid WHERE how IN ('create', 'mkdir', 'symlink') OR (how IS NULL AND f.fid IS NOT NULL)),
after AS (SELECT now.* EXCLUDE (put) FROM now LEFT JOIN top ON top.parent = now.parent AND top.name = now.name WHERE top IS NULL OR top <= put)
"""
_ENTRY = ("fid", "parent", "name", "type", "mode", "uid", "gid", "size", "mtime")


def _ops(x: Lens):
    kinds = "array('create', 'mkdir', 'symlink', 'remove', 'rmdir', 'rename', 'truncate', 'setmtime', 'setsize', 'chmod', 'chown', 'rename')"
    n = x.table("orders").agg(F.count(F.lit(1)).alias("n_files"))
    e = x.table("events").filter("event_id % 11 <> 0").withColumn("us", micros("ts")).join(F.broadcast(n))  # one row
    fid = "CASE WHEN event_id % 12 < 3 OR event_id % 5 < 2 THEN 5000000000L + event_id div 7 % 97 ELSE 1000000000L + event_id % n_files END AS fid"
    return e.selectExpr("event_id AS seq", "us", f"{kinds}[cast(event_id % 12 AS int)] AS op", fid, "10L + event_id % 5 AS parent", "concat('n', event_id % 300) AS name", "event_id % 512 AS mode", "event_id % 50 AS uid", "event_id % 10 AS gid", "event_id * 37 % 100000 AS size")


def _replayed(x: Lens):
    return rp.replay(x.fattr.select(*_ENTRY), _ops(x))


@query(OPS_SQL + "SELECT * FROM after")
def replay_namespace(x: Lens):
    """create, mkdir, symlink, remove, rmdir, rename, truncate, set size, set mtime, chmod and chown onto the snapshot."""
    return _replayed(x)


@query(OPS_SQL + """, p AS (SELECT fid, name, parent, '/' AS q FROM dirs WHERE fid = 2 UNION ALL SELECT a.fid, a.name, a.parent, CASE WHEN p.q = '/' THEN '/' || a.name ELSE p.q || '/' || a.name END
  FROM after a JOIN p ON a.parent = p.fid WHERE a.fid <> 2 AND a.type IN ('dir', 'file', 'link'))
SELECT fid, q AS path FROM p WHERE fid >= 5000000000""")
def list_replayed(x: Lens):
    """Replay, then paths of the entries that the log has made."""
    after = _replayed(x)
    return ns.all_paths(after.filter("fid >= 5000000000"), after.filter("type = 'dir'").select("fid", "parent", "name"), x.DEPTH).select("fid", "path")


@query(""", o AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN 'make_stable' ELSE 'allocate' END AS op, 1000000000 + seq // 2 % (SELECT count(*) FROM orders) AS fid, seq // 2 % 5 * 67108864 AS "offset", 9000000000000 + seq AS chunk_id, 1 + seq % 4 AS version, arg % 1000 AS size FROM oplog),
a AS (SELECT fid, "offset", max(seq) AS s, arg_max(chunk_id, seq) AS chunk_id, arg_max(version, seq) AS version FROM o WHERE op = 'allocate' GROUP BY ALL),
m AS (SELECT fid, "offset", max(seq) AS s, arg_max(size, seq) AS size FROM o WHERE op = 'make_stable' GROUP BY ALL)
SELECT coalesce(c.fid, a.fid) AS fid, coalesce(c."offset", a."offset") AS "offset", coalesce(a.chunk_id, c.chunk_id) AS chunk_id, coalesce(a.version, c.version) AS version,
CASE WHEN m.s > coalesce(a.s, -1) THEN m.size WHEN a.s IS NOT NULL THEN -1 ELSE c.size END AS size, coalesce(m.s > coalesce(a.s, -1), a.s IS NULL) AS stable
FROM chunks c FULL JOIN a ON a.fid = c.fid AND a."offset" = c."offset" LEFT JOIN m ON m.fid = coalesce(c.fid, a.fid) AND m."offset" = coalesce(c."offset", a."offset")""")
def replay_chunks(x: Lens):
    """allocate and make-stable onto the chunks."""
    fid = F.lit(1_000_000_000) + F.expr("seq div 2 % n_files")
    n = x.table("orders").agg(F.count(F.lit(1)).alias("n_files"))
    o = x.oplog.join(F.broadcast(n)).select("seq", F.when(F.col("seq") % 3 == 0, "make_stable").otherwise("allocate").alias("op"), fid.alias("fid"), F.expr("seq div 2 % 5 * 67108864").alias("offset"), (F.lit(9_000_000_000_000) + F.col("seq")).alias("chunk_id"), (F.col("seq") % 4 + 1).alias("version"), (F.col("arg") % 1000).alias("size"))
    return rp.replay_chunks(x.chunks.select("fid", "offset", "chunk_id", "version", "size", F.lit(True).alias("stable")), o)


@query("""SELECT (SELECT max(seq) + 1 FROM oplog) + n * 65536 AS fid_seed, greatest(5000, (SELECT max(arg) + 1 FROM oplog)) + n * 65536 AS chunk_seed FROM (SELECT count(*) AS n FROM oplog WHERE op = 'mkdir' AND seq % 10 = 0)""")
def roll_seeds(x: Lens):
    o = x.oplog.select("seq", F.when(F.expr("op = 'mkdir' AND seq % 10 = 0"), "roll_seeds").otherwise(F.col("op")).alias("op"), F.col("seq").alias("fid"), F.col("arg").alias("chunk_id"))
    return rp.seeds(o, 5000)


@query(""", o AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN 'clear' WHEN seq % 2 = 0 THEN 'add' ELSE 'drop' END AS op, seq // 3 % 60 AS uid, seq // 7 % 10 AS gid FROM oplog WHERE seq % 3 = 0),
c AS (SELECT gid, max(seq) AS s FROM o WHERE op = 'clear' GROUP BY gid), l AS (SELECT uid, gid, max(seq) AS s, arg_max(op, seq) AS op FROM o WHERE op <> 'clear' GROUP BY ALL)
SELECT l.uid, l.gid FROM l LEFT JOIN c USING (gid) WHERE op = 'add' AND l.s > coalesce(c.s, -2)
UNION SELECT g.uid, g.gid FROM user_group g WHERE gid NOT IN (SELECT gid FROM c) AND NOT EXISTS (SELECT 1 FROM l WHERE l.uid = g.uid AND l.gid = g.gid)""")
def replay_groups(x: Lens):
    op = F.when(F.col("seq") % 97 == 0, "clear").when(F.col("seq") % 2 == 0, "add").otherwise("drop")
    return rp.replay_groups(x.user_group, x.oplog.filter("seq % 3 = 0").select("seq", op.alias("op"), F.expr("seq div 3 % 60").alias("uid"), F.expr("seq div 7 % 10").alias("gid")))
