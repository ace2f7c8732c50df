"""Queries on counters and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EWMA, LEASE_S
from ..lens import Lens
from ..operators import counters as c
from .catalog import query


@query("SELECT event_id, server, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY server ORDER BY us, event_id), 0) AS delta FROM samples")
def counter_delta(x: Lens):
    return c.delta(x.samples).select("event_id", "server", "delta")


@query("""SELECT event_id, CASE WHEN t IS NULL THEN 0.0::DOUBLE WHEN us = t THEN NULL ELSE ((cumulative - v) * 1000000)::DOUBLE / (us - t)::DOUBLE END AS rate
FROM (SELECT *, lag(us) OVER w AS t, lag(cumulative) OVER w AS v FROM samples WINDOW w AS (PARTITION BY server ORDER BY us, event_id))""")
def counter_rate(x: Lens):
    return c.rate(x.samples).select("event_id", "rate")


@query("""SELECT event_id, cumulative - coalesce(max(cumulative) OVER (PARTITION BY server ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING),
min(cumulative) OVER (PARTITION BY server)) AS delta FROM samples""")
def interval_delta(x: Lens):
    return c.interval_delta(x.samples, 3_600_000_000).select("event_id", "delta")


@query("""SELECT event_id, (sum(cumulative) OVER w)::BIGINT AS total, CASE WHEN us // 1000000 - first_value(us) OVER w // 1000000 > 0
THEN (cumulative - first_value(cumulative) OVER w) // (us // 1000000 - first_value(us) OVER w // 1000000) ELSE 0 END AS slope
FROM samples WINDOW w AS (PARTITION BY server ORDER BY us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def value_sampler(x: Lens):
    return c.sampler(x.samples, 8).select("event_id", "total", "slope")


@query(f""", o AS (SELECT server, value, row_number() OVER (PARTITION BY server ORDER BY us, event_id) AS i FROM samples),
r AS (SELECT server, i, ((value << 12) * (4096 - {EWMA['1m']})) >> 12 AS a FROM o WHERE i = 1
UNION ALL SELECT o.server, o.i, (r.a * {EWMA['1m']} + (o.value << 12) * (4096 - {EWMA['1m']})) >> 12 FROM r JOIN o ON o.server = r.server AND o.i = r.i + 1)
SELECT server, max(i) AS n, max_by(a, i) AS avg FROM r GROUP BY server""")
def ewma(x: Lens):
    return c.ewma(x.samples, EWMA["1m"])


@query(""", l AS (SELECT * FROM (VALUES (0, 30, 10000000), (1, 30, 120000000), (2, 24, 3600000000), (3, 30, 86400000000)) t(level, slots, span)),
f AS (SELECT server, level, slots, us // span AS bucket, us, value, row_number() OVER (PARTITION BY server, level, us // span ORDER BY us, event_id) AS i FROM samples, l)
SELECT server, level, bucket, us, value FROM f WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY server, level ORDER BY bucket DESC) <= slots""")
def retention_bucketed(x: Lens):
    return c.retention(x.samples)


@query(""", s AS (SELECT us // 86400000000 AS sample, * FROM oplog), t AS (SELECT sample, op, count(*) AS total, count(*) FILTER (NOT committed) AS errors, sum(arg)::BIGINT AS time FROM s GROUP BY sample, op
UNION ALL SELECT sample, 'TOTAL', count(*), count(*) FILTER (NOT committed), sum(arg)::BIGINT FROM s GROUP BY sample)
SELECT sample, op, total, errors, time // total AS avg_arg, total * 1000 // max(total) OVER (PARTITION BY sample) AS per_mille FROM t""")
def rpc_stats(x: Lens):
    return c.rpc_stats(x.oplog)


@query("SELECT uid, fid % 100 AS server, op, count(*) AS errors FROM oplog WHERE NOT committed GROUP BY ALL")
def error_counters(x: Lens):
    return x.oplog.filter("NOT committed").groupBy("uid", (F.col("fid") % 100).alias("server"), "op").agg(F.count(F.lit(1)).alias("errors"))


@query(""", a AS (SELECT server, max(cumulative) AS v, count(*) AS n FROM samples GROUP BY server), b AS (SELECT server, max(cumulative) AS v, count(*) AS n FROM samples WHERE event_id % 2 = 0 GROUP BY server),
d AS (SELECT a.server::VARCHAR AS server, a.v - b.v AS d_v, a.n - b.n AS d_n FROM a JOIN b USING (server)) SELECT * FROM d UNION ALL SELECT 'total', sum(d_v)::BIGINT, sum(d_n)::BIGINT FROM d""")
def counter_table(x: Lens):
    snap = lambda s: s.groupBy("server").agg(F.max("cumulative").alias("v"), F.count(F.lit(1)).alias("n"))
    return c.table(snap(x.samples.filter("event_id % 2 = 0")), snap(x.samples), ["v", "n"])


@query("SELECT us // 3600000000 AS hour, op, count(*) AS n FROM oplog GROUP BY ALL")
def ops_hourly(x: Lens):
    return x.oplog.groupBy(F.expr("us div 3600000000").alias("hour"), "op").agg(F.count(F.lit(1)).alias("n"))


@query(f""", g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {LEASE_S}000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM samples WINDOW w AS (PARTITION BY server ORDER BY us, event_id)),
s AS (SELECT *, sum(start) OVER (PARTITION BY server ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT server, session, min(us) AS first, max(us) AS last, count(*) AS n FROM s GROUP BY server, session""")
def lease_sessions(x: Lens):
    return c.sessions(x.samples, "server", LEASE_S * 1_000_000)


@query("SELECT server, max(us) AS last, (SELECT max(us) FROM samples) - max(us) > 3600000000 AS down FROM samples GROUP BY server")
def heartbeat_down(x: Lens):
    now = x.samples.agg(F.max("us").alias("now"))
    rows = x.samples.groupBy("server").agg(F.max("us").alias("last")).crossJoin(F.broadcast(now))  # one row, not a pairing
    return rows.select("server", "last", (F.col("now") - F.col("last") > 3_600_000_000).alias("down"))
