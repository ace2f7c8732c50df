"""Queries on names, attributes and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..lens import Lens
from ..operators import namespace as ns
from .catalog import query

MODE_SQL = " || ".join(f"CASE WHEN mode & {1 << (8 - i)} <> 0 THEN '{'rwx'[i % 3]}' ELSE '-' END" for i in range(9))
MINUTE_SQL = "strftime(make_timestamp({0}), '%Y-%m-%d %H:%M')"
ANCESTORS_SQL = ", aa AS (SELECT fid, a FROM anc UNION ALL SELECT fid, fid FROM dirs)"


@query("SELECT fid, parent, name, type, num_replicas, size, mode FROM fattr WHERE fid = 1000000042")
def get_fattr(x: Lens):
    return x.fattr.filter("fid = 1000000042").select("fid", "parent", "name", "type", "num_replicas", "size", "mode")


@query("""SELECT a AS fid, sum(CASE WHEN type = 'file' THEN greatest(0, size) ELSE 0 END)::BIGINT AS bytes,
count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'dir') AS dirs FROM anc JOIN fattr USING (fid) GROUP BY a
UNION ALL SELECT fid, 0, 0, 0 FROM dirs WHERE fid NOT IN (SELECT a FROM anc)""")
def dir_rollup(x: Lens):
    return ns.rollup(x.files.withColumn("type", F.lit("file")), x.dirs, x.DEPTH)


@query(""", c AS (SELECT fid, parent, CASE op WHEN 'create' THEN arg WHEN 'remove' THEN -arg ELSE 0 END AS d, CASE op WHEN 'create' THEN 1 WHEN 'remove' THEN -1 ELSE 0 END AS n
FROM oplog JOIN files USING (fid) WHERE committed), aa AS (SELECT fid, a FROM anc UNION ALL SELECT fid, fid FROM dirs)
SELECT a AS fid, sum(d)::BIGINT AS d_bytes, sum(n)::BIGINT AS d_files FROM c JOIN aa ON c.parent = aa.fid GROUP BY a""")
def dir_rollup_delta(x: Lens):
    ops = x.oplog.filter("committed").join(x.files.select("fid", "parent"), "fid")
    changes = ops.selectExpr("parent", "CASE op WHEN 'create' THEN arg WHEN 'remove' THEN -arg ELSE 0L END AS d_bytes", "CASE op WHEN 'create' THEN 1L WHEN 'remove' THEN -1L ELSE 0L END AS d_files")
    return ns.rollup_deltas(changes, x.dirs, x.DEPTH)


@query("""SELECT name, has_more FROM (SELECT name, count(*) OVER () > 20 AS has_more, row_number() OVER (ORDER BY name) AS r FROM
(SELECT name FROM fattr WHERE parent = 104 AND name > 'Customer#000000100' ORDER BY name LIMIT 21)) WHERE r <= 20""")
def readdir_page(x: Lens):
    entries = x.fattr.select("fid", "parent", "name")
    return ns.page(entries, 104, "Customer#000000100", 20).select("name", "has_more")


@query("""SELECT f.fid, f.name, f.type, f.size, f.mode, max(c.chunk_id) AS last_chunk_id, max(c."offset") AS last_offset
FROM fattr f LEFT JOIN chunks c ON c.fid = f.fid WHERE f.parent = 1000007 GROUP BY ALL""")
def readdirplus(x: Lens):
    entries = x.fattr.filter("parent = 1000007").select("fid", "name", "type", "size", "mode")
    last = x.chunks.groupBy("fid").agg(F.max_by("chunk_id", "offset").alias("last_chunk_id"), F.max("offset").alias("last_offset"))
    return entries.join(last, "fid", "left")


@query("SELECT mode, " + MODE_SQL + " AS mode_string FROM (SELECT DISTINCT mode FROM fattr)")
def mode_string(x: Lens):
    return x.fattr.select("mode").distinct().select("mode", T.mode_string(F.col("mode")).alias("mode_string"))


@query(f"""SELECT path.p AS path, CASE WHEN type = 'dir' THEN 'd' ELSE '-' END || {MODE_SQL} || ' ' || CASE WHEN type = 'dir' THEN '-' ELSE greatest(1, num_replicas)::VARCHAR END
|| ' ' || uid || ' ' || gid || ' ' || greatest(0, size) || ' ' || {MINUTE_SQL.format('mtime')} || ' ' || path.p AS line FROM fattr JOIN path USING (fid)""")
def ls(x: Lens):
    rows = ns.all_paths(x.fattr, x.dirs, x.DEPTH)
    is_dir = F.col("type") == "dir"
    replicas = F.when(is_dir, "-").otherwise(F.greatest(F.lit(1), F.col("num_replicas")).cast("string"))
    parts = [F.concat(F.when(is_dir, "d").otherwise("-"), T.mode_string(F.col("mode"))), replicas, F.col("uid").cast("string"), F.col("gid").cast("string")]
    parts += [F.greatest(F.lit(0), F.col("size")).cast("string"), T.ls_minute(F.col("mtime")), F.col("path")]
    return rows.select("path", F.concat_ws(" ", *parts).alias("line"))


@query(f"""SELECT fid, greatest(0, size) || '|' || CASE WHEN type = 'dir' THEN 'directory' ELSE 'regular file' END || '|' || name || '|67108864|'
|| CASE WHEN type = 'dir' THEN 0 ELSE greatest(1, num_replicas) END || '|' || {MINUTE_SQL.format('mtime')} || ' |' || mtime // 1000000 || '|q' AS stat FROM fattr""")
def stat_fmt(x: Lens):
    return x.fattr.select("fid", T.stat_format("%b|%F|%n|%o|%r|%y|%Y|%q").alias("stat"))


@query("""SELECT fid, name, type, CASE WHEN type = 'file' THEN num_replicas END AS replicas, CASE WHEN type = 'file' THEN chunk_count END AS chunk_count,
CASE WHEN type = 'file' THEN size END AS size, CASE WHEN num_stripes > 0 THEN num_stripes || '+' || num_recovery || ':' || stripe_size END AS striping,
uid, gid, mode, mtime // 1000000 AS mtime_s, mtime % 1000000 AS mtime_us FROM fattr""")
def astat(x: Lens):
    only = lambda c: F.when(F.col("type") == "file", F.col(c))
    striping = F.when(F.col("num_stripes") > 0, F.concat(F.col("num_stripes").cast("string"), F.lit("+"), F.col("num_recovery").cast("string"), F.lit(":"), F.col("stripe_size").cast("string")))
    return x.fattr.select(
        "fid", "name", "type", only("num_replicas").alias("replicas"), only("chunk_count").alias("chunk_count"), only("size").alias("size"), striping.alias("striping"),
        "uid", "gid", "mode", F.expr("mtime div 1000000").alias("mtime_s"), (F.col("mtime") % 1000000).alias("mtime_us"),
    )


@query("SELECT fid, true AS e, type = 'dir' AS d, type = 'file' AND size = 0 AS z FROM fattr")
def test_flags(x: Lens):
    return x.fattr.select("fid", F.lit(True).alias("e"), (F.col("type") == "dir").alias("d"), ((F.col("type") == "file") & (F.col("size") == 0)).alias("z"))


@query(r"SELECT fid, p AS path FROM path WHERE regexp_matches(p, '^/A[^/]*/NATION_[0-5]/Customer#0000000[^/][^/]/o[1-3][^/]*$')")
def glob(x: Lens):
    return ns.all_paths(x.fattr, x.dirs, x.DEPTH).filter(F.col("path").rlike(T.glob_regex("/A*/NATION_[0-5]/Customer#0000000??/o[1-3]*"))).select("fid", "path")


@query(""", r AS (SELECT fid, u AS euid, (fid + u) % 10 AS egid FROM files, (VALUES (0), (7), (23), (41)) t(u))
SELECT r.fid, euid, CASE WHEN euid = 0 THEN true WHEN uid = euid THEN mode & 128 <> 0 WHEN gid = egid OR (euid, gid) IN (SELECT (uid, gid) FROM user_group) THEN mode & 16 <> 0 ELSE mode & 2 <> 0 END AS allowed FROM r JOIN files f USING (fid)""")
def can_access(x: Lens):
    """Four users ask to write every file."""
    euid = F.explode(F.array(*[F.lit(u).cast("long") for u in (0, 7, 23, 41)]))
    asked = x.files.select("fid", euid.alias("euid")).withColumn("egid", (F.col("fid") + F.col("euid")) % 10)
    return ns.can_access(x.files, asked, x.user_group, 2)


@query(""", f AS (SELECT fid, parent, uid, CASE WHEN type = 'dir' AND fid % 3 = 0 THEN mode + 512 ELSE mode END AS mode FROM fattr), r AS (SELECT fid, fid % 2 * (fid % 50) AS euid FROM files)
SELECT r.fid, r.euid, NOT (d.mode >= 512 AND r.euid NOT IN (0, f.uid, d.uid)) AS allowed FROM r JOIN f ON f.fid = r.fid JOIN f d ON d.fid = f.parent""")
def sticky_delete(x: Lens):
    """A third of the directories are sticky."""
    f = x.fattr.withColumn("mode", F.when((F.col("type") == "dir") & (F.col("fid") % 3 == 0), F.col("mode") + 512).otherwise(F.col("mode")))
    return ns.may_delete(x.files.select("fid", (F.col("fid") % 2 * (F.col("fid") % 50)).alias("euid")), f)


@query("""SELECT name, name NOT IN ('', '.', '..') AND position('/' IN name) = 0 AND position(chr(10) IN name) = 0 AND position(chr(13) IN name) = 0 AND strlen(name) <= 4096 AS valid
FROM (SELECT CASE fid % 8 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN 'a/' || name WHEN 3 THEN '' WHEN 4 THEN name || chr(10) WHEN 5 THEN repeat('é', 2048 + (fid // 8 % 2)::INT) ELSE name END AS name FROM files)""")
def name_valid(x: Lens):
    name = F.expr("CASE fid % 8 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN concat('a/', name) WHEN 3 THEN '' WHEN 4 THEN concat(name, chr(10)) WHEN 5 THEN repeat('é', cast(2048 + fid div 8 % 2 AS int)) ELSE name END")
    return x.files.select(name.alias("name")).withColumn("valid", ns.valid_name(F.col("name")))


@query("SELECT fid, min_tier, max_tier FROM files WHERE max_tier >= 2 AND min_tier <= 2")
def tier_filter(x: Lens):
    return x.files.filter(ns.tier_overlap(2, 2)).select("fid", "min_tier", "max_tier")


@query("SELECT fid, p AS path FROM path WHERE fid IN (SELECT fid FROM oplog WHERE op = 'remove' AND committed)")
def list_paths(x: Lens):
    wanted = x.oplog.filter("op = 'remove' AND committed").select("fid")
    return ns.all_paths(x.files.select("fid", "parent", "name"), x.dirs, x.DEPTH).join(wanted, "fid", "left_semi").select("fid", "path")


@query("SELECT seq, op, name FROM oplog JOIN files USING (fid) WHERE op IN ('create', 'remove', 'truncate') AND name NOT LIKE '%.tmp'")
def worm_violations(x: Lens):
    ops = x.oplog.select("seq", "op", "fid").filter(F.col("op").isin("create", "remove", "truncate"))
    names = x.attributes.select("fid", "name").repartition(x.parts, "fid")
    return ops.repartition(x.parts, "fid").join(names, "fid").filter(~F.col("name").endswith(".tmp")).select("seq", "op", "name")


@query("""SELECT size, CASE WHEN n >> 10 < 1024 THEN h0 WHEN n >> 20 < 1024 THEN h1 WHEN n >> 30 < 1024 THEN h2 ELSE h3 END AS human FROM
(SELECT size, n, """ + ", ".join(
    f"((n >> {10 * i + 10}) + (((n >> {10 * i}) & 1023) * 100 + 512) // 102400)::VARCHAR || CASE WHEN f{i} = 0 THEN '' ELSE rtrim('.' || lpad(f{i}::VARCHAR, 2, '0'), '0') END || ' {u}B' AS h{i}" for i, u in enumerate("KMGT")
) + " FROM (SELECT size, n, " + ", ".join(f"((((n >> {10 * i}) & 1023) * 100 + 512) >> 10) % 100 AS f{i}" for i in range(4)) + """
FROM (SELECT DISTINCT size, greatest(0, size) AS n FROM (SELECT size * 1023 AS size FROM files UNION ALL SELECT size FROM files UNION ALL SELECT fid % 3000000 FROM files))))""")  # fmt: skip
def human_size(x: Lens):
    sizes = x.files.selectExpr("size * 1023 AS size").union(x.files.select("size")).union(x.files.selectExpr("fid % 3000000")).distinct()
    return sizes.select("size", T.human_size(F.col("size")).alias("human"))


@query("SELECT p AS path, fid, type FROM path JOIN fattr USING (fid) WHERE p LIKE '/ASIA/%' OR p = '/ASIA'")
def lookup_path(x: Lens):
    return ns.all_paths(x.fattr, x.dirs, x.DEPTH).filter("path = '/ASIA' OR path LIKE '/ASIA/%'").select("path", "fid", "type")


@query("SELECT fid, p AS path FROM path")
def get_pathname(x: Lens):
    return ns.all_paths(x.fattr.select("fid", "parent", "name"), x.dirs, x.DEPTH).select("fid", "path")


@query(ANCESTORS_SQL + """, r AS (SELECT a AS fid, sum(size)::BIGINT AS bytes FROM aa JOIN files ON files.parent = aa.fid GROUP BY a)
SELECT f.fid, f.name, CASE WHEN type = 'dir' THEN coalesce(bytes, 0) ELSE size END AS bytes FROM fattr f LEFT JOIN r USING (fid) WHERE f.parent = 100 + 3""")
def du(x: Lens):
    sums = ns.rollup(x.files.withColumn("type", F.lit("file")), x.dirs, x.DEPTH).select("fid", "bytes")
    bytes_ = F.when(F.col("type") == "dir", F.coalesce("bytes", F.lit(0))).otherwise(F.col("size"))
    return x.fattr.filter("parent = 103").join(sums, "fid", "left").select("fid", "name", bytes_.alias("bytes"))


@query(ANCESTORS_SQL + " SELECT d.name, coalesce(sum(size), 0)::BIGINT AS bytes FROM dirs d JOIN aa ON aa.a = d.fid LEFT JOIN files ON files.parent = aa.fid WHERE d.parent = 2 AND d.fid <> 2 GROUP BY d.name")
def dus(x: Lens):
    sums = ns.rollup(x.files.withColumn("type", F.lit("file")), x.dirs, x.DEPTH)
    return x.dirs.filter("parent = 2 AND fid <> 2").join(sums, "fid").select("name", "bytes")


@query(ANCESTORS_SQL + """, r AS (SELECT a AS fid, count(*) AS n, sum(size)::BIGINT AS bytes FROM aa JOIN files ON files.parent = aa.fid GROUP BY a),
d AS (SELECT a AS fid, count(*) AS n FROM aa WHERE aa.fid <> 2 AND aa.fid IN (SELECT fid FROM dirs) GROUP BY a)
SELECT dirs.fid, (coalesce(d.n, 0) + CASE WHEN dirs.fid = 2 THEN 1 ELSE 0 END)::BIGINT AS dirs, coalesce(r.n, 0) AS files, coalesce(bytes, 0) AS bytes,
'none' AS quota, 'inf' AS remaining FROM dirs LEFT JOIN d USING (fid) LEFT JOIN r USING (fid)""")
def count(x: Lens):
    sums = ns.rollup(x.files.withColumn("type", F.lit("file")), x.dirs, x.DEPTH)
    return sums.select("fid", (F.col("dirs") + 1).alias("dirs"), "files", "bytes", F.lit("none").alias("quota"), F.lit("inf").alias("remaining"))


@query(ANCESTORS_SQL + """ SELECT a AS fid, count(f.fid) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(sum(chunk_count), 0)::BIGINT AS chunks,
count(*) FILTER (size = 0 AND chunk_count <= 0) AS empty, count(*) FILTER (size = 0 AND chunk_count > 0) AS abandoned
FROM aa LEFT JOIN files f ON f.parent = aa.fid AND max_tier >= 1 AND min_tier <= 3 GROUP BY a""")
def dir_summary(x: Lens):
    rows = x.files.filter(ns.tier_overlap(1, 3)).withColumn("type", F.lit("file"))
    return ns.rollup(rows, x.dirs, x.DEPTH, ns.summary_counts()).drop("dirs")


@query("""SELECT fid, mode, (mode | 16 | CASE WHEN type = 'dir' OR mode & 73 <> 0 THEN 8 ELSE 0 END) & ~2 & ~4 AS new_mode FROM fattr""")
def chmod_apply(x: Lens):
    return x.fattr.select("fid", "mode", T.chmod(F.col("mode"), F.col("type") == "dir", "g+wX,o-rw").alias("new_mode"))


@query("""SELECT fid, coalesce(CASE WHEN uid % 7 = 0 THEN NULL ELSE 'user' || uid END, '?') AS owner, CASE WHEN gid = 0 THEN '-' ELSE 'group' || gid END AS grp FROM files""")
def owner_names(x: Lens):
    users = x.spark.range(50).filter("id % 7 <> 0").selectExpr("id AS uid", "concat('user', id) AS owner")
    rows = x.files.select("fid", "uid", "gid").join(F.broadcast(users), "uid", "left")
    return rows.select("fid", F.coalesce("owner", F.lit("?")).alias("owner"), F.when(F.col("gid") == 0, "-").otherwise(F.concat(F.lit("group"), "gid")).alias("grp"))
