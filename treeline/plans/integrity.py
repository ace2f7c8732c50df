"""Queries on the health of chunks, files and servers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checksums import object_key
from ..lens import Lens
from ..operators import integrity as ok
from ..operators import placement as pl
from .catalog import query

NOW_US = 1_700_000_000_000_000

STATES_SQL = """, pc AS (SELECT chunk_id, count(*) AS n, min(server_id) AS a, max(server_id) AS b, min(rack) AS ra, max(rack) AS rb FROM replicas JOIN servers USING (server_id) GROUP BY chunk_id),
st AS (SELECT c.fid, (c."offset" // 67108864) // CASE WHEN num_stripes > 0 THEN num_stripes + num_recovery ELSE 1 END AS block, c.chunk_id, num_recovery AS m, num_replicas,
coalesce(n, 0) AS n, CASE WHEN a = b THEN a END AS ss, CASE WHEN ra = rb THEN ra END AS sr FROM chunks c JOIN files f ON c.fid = f.fid LEFT JOIN pc ON pc.chunk_id = c.chunk_id),
b0 AS (SELECT fid, block, max(m) AS m, count(*) FILTER (n = 0) AS missing FROM st GROUP BY fid, block),
bs AS (SELECT fid, block, max(c) AS c FROM (SELECT fid, block, ss, count(*) AS c FROM st WHERE ss IS NOT NULL GROUP BY ALL) GROUP BY fid, block),
br AS (SELECT fid, block, max(c) AS c FROM (SELECT fid, block, sr, count(*) AS c FROM st WHERE sr IS NOT NULL GROUP BY ALL) GROUP BY fid, block),
bl AS (SELECT b0.*, coalesce(bs.c, 0) AS by_server, coalesce(br.c, 0) AS by_rack FROM b0 LEFT JOIN bs USING (fid, block) LEFT JOIN br USING (fid, block)),
pf2 AS (SELECT fid, bool_or(missing > m) AS l, bool_or(missing + by_server > m) AS s, bool_or(missing + by_rack > m) AS r FROM bl GROUP BY fid),
fs AS (SELECT f.*, CASE WHEN l THEN 1 WHEN s THEN 2 WHEN r THEN 3 WHEN size = 0 AND chunk_count > 0 AND mtime + 1000000000 < 1700000000000000 THEN 4 ELSE 5 END AS state
FROM files f LEFT JOIN pf2 USING (fid) WHERE num_replicas > 0)
"""


def _states(x: Lens):
    states = ok.chunk_states(x.files, x.chunks, x.replicas, x.places)
    return states, ok.block_states(states)


@query(STATES_SQL + "SELECT fid, state, size, chunk_count FROM fs")
def fsck_files(x: Lens):
    return ok.file_states(x.files, _states(x)[1], NOW_US).select("fid", "state", "size", "chunk_count")


SUMMARY_SQL = STATES_SQL + """, a AS (SELECT count(*) AS files, count(*) FILTER (num_stripes > 0) AS striped, count(*) FILTER (num_recovery > 0) AS with_recovery, count(*) FILTER (state = 1) AS lost,
count(*) FILTER (state = 2) AS lost_if_server_down, count(*) FILTER (state = 3) AS lost_if_rack_down, count(*) FILTER (state = 4) AS abandoned, count(*) FILTER (state = 5) AS ok,
max(size) AS max_size, max(chunk_count) AS max_chunks, max(num_replicas) AS max_replication, sum(size)::BIGINT AS bytes FROM fs),
b AS (SELECT count(*) AS chunks, sum(n)::BIGINT AS replicas, count(*) FILTER (n = 0) AS lost_chunks, count(*) FILTER (n > 0 AND n < num_replicas) AS under_replicated, count(*) FILTER (n > num_replicas) AS over_replicated FROM st),
c AS (SELECT count(*) AS blocks, count(*) FILTER (m > 0 AND missing > 0 AND missing <= m) AS partial_recovery FROM bl),
s AS (SELECT measure, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE value) UNION ALL SELECT measure, value FROM (UNPIVOT b ON COLUMNS(*) INTO NAME measure VALUE value)
UNION ALL SELECT measure, value FROM (UNPIVOT c ON COLUMNS(*) INTO NAME measure VALUE value))
"""


@query(SUMMARY_SQL + "SELECT * FROM s")
def fsck_summary(x: Lens):
    return ok.fsck_summary(ok.file_states(x.files, _states(x)[1], NOW_US))


@query(SUMMARY_SQL + """SELECT measure, value, CASE WHEN measure IN ('files', 'striped', 'with_recovery', 'lost', 'lost_if_server_down', 'lost_if_rack_down', 'abandoned', 'ok')
THEN ((20000 * value + n) // (2 * n))::DOUBLE / 100 END AS percent FROM s, (SELECT count(*) AS n FROM fs)""")
def fsck_report(x: Lens):
    """The summary with each count's share of the files."""
    return ok.fsck_report(ok.fsck_summary(ok.file_states(x.files, _states(x)[1], NOW_US)))


@query(STATES_SQL + "SELECT fid, block, m, missing, missing <= m AS recoverable FROM bl")
def recoverable_blocks(x: Lens):
    return _states(x)[1].select("fid", "block", "m", "missing", (F.col("missing") <= F.col("m")).alias("recoverable"))


@query(STATES_SQL + """, w AS (SELECT r.fid, num_stripes AS ns, r.chunk_id, k, server_id, rack, (c."offset" // 67108864) // CASE WHEN num_stripes > 0 THEN num_stripes + num_recovery ELSE 1 END AS block
FROM replicas r JOIN chunks c ON c.chunk_id = r.chunk_id JOIN files f ON f.fid = r.fid JOIN servers USING (server_id)),
v AS (SELECT ns, row_number() OVER (PARTITION BY fid, block, server_id ORDER BY chunk_id, k) AS a, row_number() OVER (PARTITION BY fid, block, chunk_id, server_id ORDER BY chunk_id, k) AS b,
row_number() OVER (PARTITION BY fid, block, rack ORDER BY chunk_id, k) AS c FROM w)
SELECT 'same_node' AS measure, count(*) FILTER (a > 1 AND (ns = 0 OR b > 1)) AS value FROM v UNION ALL SELECT 'stripe_same_node', count(*) FILTER (a > 1 AND ns > 0 AND b = 1) FROM v
UNION ALL SELECT 'same_rack', count(*) FILTER (a = 1 AND c > 1) FROM v UNION ALL SELECT 'missing', count(*) FILTER (n = 0) FROM st UNION ALL SELECT 'under', count(*) FILTER (n > 0 AND n < num_replicas) FROM st
UNION ALL SELECT 'over', count(*) FILTER (n > num_replicas) FROM st UNION ALL SELECT 'chunks', count(*) FROM st""")
def replica_check(x: Lens):
    return ok.replica_check(_states(x)[0], x.files, x.chunks, x.replicas, x.places)


@query("SELECT chunk_id, k, server_id, version, v AS first_version FROM (SELECT *, first_value(version) OVER w AS v, first_value(size) OVER w AS s FROM replicas WINDOW w AS (PARTITION BY chunk_id ORDER BY k)) WHERE version <> v OR size <> s")
def replica_mismatch(x: Lens):
    return ok.mismatches(x.replicas)


@query("SELECT chunk_id, k, server_id, version, newest FROM (SELECT *, max(version) OVER (PARTITION BY chunk_id) AS newest FROM replicas) WHERE version < newest")
def stale_replicas(x: Lens):
    return ok.stale(x.replicas)


@query("SELECT server_id, count(*) AS n, sum(chunk_id)::VARCHAR AS ids, sum(version)::VARCHAR AS versions FROM replicas GROUP BY server_id")
def cid_checksum(x: Lens):
    return ok.checksums(x.replicas)


@query(""", e AS (SELECT DISTINCT server_id, chunk_id, version FROM replicas), r AS (SELECT server_id, chunk_id, CASE WHEN chunk_id % 101 = 0 AND server_id % 3 = 0 THEN version + 1 ELSE version END AS version FROM e
WHERE NOT (server_id % 3 = 1 AND chunk_id % 53 = 0) UNION ALL SELECT server_id, -chunk_id, version FROM e WHERE server_id % 3 = 1 AND chunk_id % 977 = 0)
SELECT server_id, chunk_id, CASE WHEN r.version IS NULL THEN 'missing' WHEN e.version IS NULL THEN 'unknown' ELSE 'version' END AS problem
FROM e FULL JOIN r USING (server_id, chunk_id) WHERE r.version IS NULL OR e.version IS NULL OR r.version <> e.version""")
def inventory_diff(x: Lens):
    e = x.replicas.select("server_id", "chunk_id", "version").repartition(x.parts, "server_id", "chunk_id").distinct()
    version = F.when((F.col("chunk_id") % 101 == 0) & (F.col("server_id") % 3 == 0), F.col("version") + 1).otherwise(F.col("version"))
    row = lambda keep, *cols: F.when(F.expr(keep), F.struct(*[c.cast("long").alias(k) for c, k in zip(cols, ("server_id", "chunk_id", "version"), strict=True)]))
    told = row("NOT (server_id % 3 = 1 AND chunk_id % 53 = 0)", F.col("server_id"), F.col("chunk_id"), version)
    extra = row("server_id % 3 = 1 AND chunk_id % 977 = 0", F.col("server_id"), -F.col("chunk_id"), F.col("version"))
    # Both reports of a copy at once, so that what is expected is computed and dealt once.
    r = e.select(F.explode(F.filter(F.array(told, extra), lambda t: t.isNotNull())).alias("t")).select("t.*")
    return ok.inventory_diff(e, r.repartition(x.parts, "server_id", "chunk_id"))


@query(""", w AS (SELECT fid, unnest(range(0, (size - 1) // 67108864 + 1)) AS block FROM files WHERE size > 0)
SELECT fid, min(block) AS first_gap FROM w LEFT JOIN chunks c USING (fid) WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.fid = w.fid AND d.idx = w.block AND (d.fid + d.idx) % 23 <> 0) GROUP BY fid""")
def objstore_lost(x: Lens):
    """The chunks that there are, but for one in 23, stand for the objects."""
    return ok.objects_lost(x.files, x.chunks.filter("(fid + idx) % 23 <> 0").select("fid", F.col("idx").alias("block")))


@query(""", o AS (SELECT c.chunk_id, c.fid % 9 AS k, CASE c.fid % 9 WHEN 1 THEN c.fid + 7000000000 ELSE c.fid END AS fid, CASE c.fid % 9 WHEN 2 THEN idx + 40 ELSE idx END AS block, CASE c.fid % 9 WHEN 4 THEN 5 ELSE 0 END AS shift FROM chunks c)
SELECT * FROM (SELECT o.chunk_id, CASE WHEN k = 0 THEN 'malformed' WHEN k = 3 THEN 'wrong key' WHEN f.fid IS NULL THEN CASE WHEN o.fid <= 8000000500 AND block % 4 <> 1 THEN 'no file' END WHEN o.fid % 10 = 0 THEN 'replicated'
WHEN size <= 0 THEN NULL WHEN shift > 0 THEN 'position' WHEN block * 67108864 >= size THEN 'past the end' END AS problem FROM o LEFT JOIN files f ON f.fid = o.fid) WHERE problem IS NOT NULL""")
def objstore_stray(x: Lens):
    """Keys of the chunks as objects: some malformed, of no file, past the end, with another check text, or off a block's start.  Blocks 1, 5, ... of files that are gone wait to be deleted."""
    kind = F.col("fid") % 9
    files = x.files.withColumn("num_replicas", (F.col("fid") % 10 == 0).cast("long"))
    fid = F.when(kind == 1, F.col("fid") + 7_000_000_000).otherwise(F.col("fid"))
    tier = F.when(kind == 1, 0).otherwise(F.col("min_tier"))
    version = -(F.col("idx") + F.when(kind == 2, 40).otherwise(0)) * (64 << 20) - 1 - tier - F.when(kind == 4, 5).otherwise(0)
    rows = x.chunks.join(files.select("fid", "min_tier"), "fid").select("chunk_id", "idx", kind.alias("kind"), fid.alias("f"), version.alias("v"))
    key = object_key(F.lit(77).cast("long"), F.col("f"), F.col("f"), F.col("v"))
    key = F.when(F.col("kind") == 0, F.concat(F.lit("junk"), F.col("chunk_id"))).when(F.col("kind") == 3, F.concat(F.lit("A"), key)).otherwise(key)
    pending = rows.filter("idx % 4 = 1").select(F.col("f").alias("fid"), F.col("v").alias("version"))
    return ok.objects_stray(ok.objects_found(rows.select("chunk_id", key.alias("key")), 77), files, pending, 8_000_000_500).select("chunk_id", "problem")


@query("SELECT host, port FROM servers WHERE server_id % 5 = 0 AND server_id % 7 = 0")
def down_not_up(x: Lens):
    s = x.places.select("server_id", "host", "port")
    return s.filter("server_id % 5 = 0").select("host", "port").subtract(s.filter("server_id % 7 <> 0").select("host", "port"))


@query("SELECT host, port FROM servers WHERE server_id % 4 = 0 AND server_id % 7 <> 0")
def retiring_up(x: Lens):
    s = x.places.select("server_id", "host", "port")
    up = s.filter("server_id % 7 <> 0").select("host", "port")
    return s.filter("server_id % 4 = 0").select("host", "port").join(up, ["host", "port"], "left_semi")


@query("""SELECT server_id, CASE WHEN starts_with(host, 'Supplier#00000001') AND length(host) >= 18 THEN 1 WHEN starts_with(host, 'Supplier#0000000') AND length(host) >= 18 THEN 2
WHEN starts_with(host, 'Supplier#') THEN 3 ELSE -1 END::BIGINT AS rack FROM servers""")
def rack_by_prefix(x: Lens):
    rules = x.spark.createDataFrame([(0, "Supplier#00000001?", 1), (1, "Supplier#0000000??", 2), (2, "Supplier#", 3)], "ord int, prefix string, rack long")
    return ok.rack_by_prefix(x.places.select("server_id", "host"), rules)


@query("SELECT s.server_id, rack, count(chunk_id) AS chunks, used, total, used * 1000000 // total AS util FROM servers s LEFT JOIN replicas r USING (server_id) GROUP BY ALL")
def server_usage(x: Lens):
    return pl.usage(x.replicas, x.places)


@query(""", u AS (SELECT server_id, used * 1000000 // total AS util FROM servers), m AS (SELECT sum(util)::BIGINT // count(*) AS mean FROM u), t AS (SELECT u.*, greatest(0, mean - 2000) AS low, least(1000000, mean + 2000) AS high FROM u, m)
SELECT server_id, util, low, high, CASE WHEN util > high THEN 'over' WHEN util < low THEN 'under' ELSE 'within' END AS side FROM t""")
def rebalance_thresholds(x: Lens):
    return pl.thresholds(pl.usage(x.replicas, x.places), 4000)


#: Half of this on either side of the mean: the spread of use is some hundreds of millionths.
VARIATION = 200
REBALANCE_SQL = """, u AS (SELECT server_id, rack, total, used, used * 1000000 // total AS util FROM servers), m AS (SELECT sum(util)::BIGINT // count(*) AS mean FROM u),
v AS (SELECT u.*, greatest(0, mean - 100) AS low, least(1000000, mean + 100) AS high, total // 1000000 * ((greatest(0, mean - 100) + least(1000000, mean + 100)) // 2) AS level FROM u, m),
mv AS (SELECT r.*, v.used - v.level AS surplus, sum(r.size) OVER (PARTITION BY r.server_id ORDER BY r.size DESC, r.chunk_id, r.k ROWS UNBOUNDED PRECEDING) AS upto FROM replicas r JOIN v ON v.server_id = r.server_id WHERE util > high),
mo AS (SELECT * FROM mv WHERE upto <= surplus),
so AS (SELECT server_id, coalesce(sum(out) OVER (ORDER BY server_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT server_id, sum(size) AS out FROM mo GROUP BY 1)),
tk AS (SELECT server_id AS to_server, rack AS to_rack, level - used AS room, sum(level - used) OVER (ORDER BY level - used DESC, server_id ROWS UNBOUNDED PRECEDING) AS hi FROM v WHERE util < low),
pl AS (SELECT mo.*, to_server, to_rack FROM mo JOIN so ON so.server_id = mo.server_id JOIN tk ON start + upto - size >= hi - room AND start + upto <= hi),
ok AS (SELECT pl.*, row_number() OVER (PARTITION BY chunk_id ORDER BY k) AS one FROM pl
  WHERE NOT EXISTS (SELECT 1 FROM replicas r JOIN servers s ON s.server_id = r.server_id WHERE r.chunk_id = pl.chunk_id AND r.k <> pl.k AND (s.server_id = to_server OR s.rack = to_rack)))
"""


@query(REBALANCE_SQL + "SELECT chunk_id, server_id AS from_server, to_server FROM ok WHERE one = 1")
def rebalance_plan(x: Lens):
    """The first round; ``placement.rebalance`` repeats rounds.  Invariants are tested: takers stay under the mean, no rack or server gets a second copy, no copy is lost."""
    return pl.plan_round(x.replicas, x.places, VARIATION)


@query("""SELECT count(*) AS servers, count(*) FILTER (server_id % 7 <> 0) AS up, count(*) FILTER (server_id % 7 = 0) AS down, count(*) FILTER (server_id % 4 = 0 AND server_id % 7 <> 0) AS retiring,
sum(total)::BIGINT AS total, sum(used)::BIGINT AS used, (sum(total) - sum(used))::BIGINT AS free FROM servers""")
def cluster_totals(x: Lens):
    up, retiring = F.col("server_id") % 7 != 0, F.col("server_id") % 4 == 0
    n = lambda c: F.sum(c.cast("long"))
    return x.servers.agg(F.count(F.lit(1)).alias("servers"), n(up).alias("up"), n(~up).alias("down"), n(up & retiring).alias("retiring"), F.sum("total").alias("total"), F.sum("used").alias("used"), (F.sum("total") - F.sum("used")).alias("free"))


@query("""SELECT server_id, CASE WHEN server_id % 11 = 0 THEN 'stopped' WHEN server_id % 7 = 0 THEN 'disconnected' WHEN server_id % 4 = 0 THEN 'retiring' WHEN used * 1000000 // total > 3000 THEN 'overloaded' ELSE 'up' END AS status FROM servers""")
def host_status(x: Lens):
    i, util = F.col("server_id"), F.expr("used * 1000000 div total")
    status = F.when(i % 11 == 0, "stopped").when(i % 7 == 0, "disconnected").when(i % 4 == 0, "retiring").when(util > 3000, "overloaded").otherwise("up")
    return x.servers.select("server_id", status.alias("status"))


@query("""SELECT rack, count(*) AS servers, count(*) FILTER (server_id % 7 <> 0) AS up, (sum(total) - sum(used))::BIGINT AS free,
CASE WHEN count(*) FILTER (server_id % 7 <> 0) * 2 < count(*) THEN 'servers down' WHEN (sum(total) - sum(used)) * 20 < sum(total) THEN 'not enough space' ELSE 'healthy' END AS health FROM servers GROUP BY rack""")
def rack_health(x: Lens):
    up = F.sum((F.col("server_id") % 7 != 0).cast("long"))
    n, free = F.count(F.lit(1)), F.sum("total") - F.sum("used")
    health = F.when(up * 2 < n, "servers down").when(free * 20 < F.sum("total"), "not enough space").otherwise("healthy")
    return x.servers.groupBy("rack").agg(n.alias("servers"), up.alias("up"), free.alias("free"), health.alias("health"))


@query("""SELECT rack, '[' || string_agg('{"host":"' || host || '","port":' || port || ',"chunks":' || n || '}', ',' ORDER BY server_id) || ']' AS servers
FROM (SELECT s.rack, s.host, s.port, s.server_id, count(chunk_id) AS n FROM servers s LEFT JOIN replicas USING (server_id) GROUP BY ALL) GROUP BY rack""")
def query_chunkserverdirs(x: Lens):
    s = x.places.select("server_id", "host", "port")
    rows = pl.usage(x.replicas, x.places).join(s, "server_id")
    per = F.array_sort(F.collect_list(F.struct("server_id", "host", "port", "chunks")))
    slim = F.transform(F.col("all"), lambda r: F.struct(r["host"].alias("host"), r["port"].alias("port"), r["chunks"].alias("chunks")))
    return rows.groupBy("rack").agg(per.alias("all")).select("rack", F.to_json(slim).alias("servers"))
