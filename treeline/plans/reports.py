"""Queries behind reports and tools: displays, listings, merges, candidates and plan counters."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from ..functions import checksums as cs
from ..functions import text as T
from ..lens import Lens, micros
from ..operators import counters as c
from ..operators import layout as lo
from ..operators import placement as pl
from ..sources import audit_text, counters_csv
from .catalog import query
from .integrity import NOW_US, REBALANCE_SQL, VARIATION


@query("""SELECT fid, CASE WHEN v > 1125899906842624 THEN printf('%.2f&nbsp;PB', v / 1125899906842624::DOUBLE) WHEN v > 1099511627776 THEN printf('%.2f&nbsp;TB', v / 1099511627776::DOUBLE)
WHEN v > 1073741824 THEN printf('%.2f&nbsp;GB', v / 1073741824::DOUBLE) WHEN v > 1048576 THEN printf('%.2f&nbsp;MB', v / 1048576::DOUBLE) ELSE printf('%d.00&nbsp;bytes', v) END AS readable,
format('{:,}', v) AS digits FROM (SELECT fid, CASE fid % 4 WHEN 0 THEN size WHEN 1 THEN size * 97 WHEN 2 THEN size * 9973 ELSE size * 10000019 END AS v FROM files)""")
def readable_bytes(x: Lens):
    """Sizes as the status page has them, and with separators of thousands."""
    v = F.expr("CASE fid % 4 WHEN 0 THEN size WHEN 1 THEN size * 97 WHEN 2 THEN size * 9973 ELSE size * 10000019 END")
    return x.files.select("fid", T.readable_bytes(v).alias("readable"), F.format_number(v, 0).alias("digits"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS us FROM events""", tables=False)
def iso_parse(x: Lens):
    """Times read back from their text; every fifth is cut short or has another month, and is null."""
    iso = T.iso_micros(micros("ts"))
    bad = F.when(F.col("event_id") % 2 == 0, F.substring(iso, 1, 26)).otherwise(F.concat(F.substring(iso, 1, 5), F.lit("13"), F.substring(iso, 8, 20)))
    text = F.when(F.col("event_id") % 5 == 0, bad).otherwise(iso)
    return x.table("events").select("event_id", T.parse_iso(text).alias("us"))


@query("""SELECT event_id, coalesce(nullif(regexp_extract(props, '"k": *([0-9-]+)', 1), ''), 'none') AS k, 'fixed' AS mode, 2::BIGINT AS n FROM events""", tables=False)
def merge_props(x: Lens):
    """Defaults, and over them what an event says."""
    said = F.str_to_map(F.regexp_replace("props", '[{}" ]', ""), F.lit(","), F.lit(":"))
    base = F.create_map(F.lit("k"), F.lit("none"), F.lit("mode"), F.lit("fixed"))
    both = T.override(base, F.map_filter(F.coalesce(said, F.create_map().cast("map<string,string>")), lambda k, v: k == "k"))
    return x.table("events").select("event_id", both["k"].alias("k"), both["mode"].alias("mode"), F.size(both).cast("long").alias("n"))


@query("SELECT server, max(us) AS us, max_by(value, (us, event_id)) AS value FROM samples WHERE server IN (SELECT server_id FROM servers WHERE rack = 4) GROUP BY server")
def counters_of_hosts(x: Lens):
    return c.of_hosts(x.samples, x.places.filter("rack = 4").select(F.col("server_id").alias("server")))


@query("SELECT parent, fid, (sum(size) OVER (PARTITION BY parent ORDER BY name, fid) - size)::BIGINT AS at, size FROM files")
def merged_ranges(x: Lens):
    return lo.merged_ranges(x.files)


@query("""SELECT fid, 'o&<' || name AS key, size FROM files""")
def listing_keys(x: Lens):
    """Keys and sizes read from a listing's XML, an object in each."""
    name = F.concat(F.lit("<ListBucketResult><Contents><Key>o&amp;&lt;"), "name", F.lit("</Key><Size>"), F.col("size").cast("string"), F.lit("</Size></Contents></ListBucketResult>"))
    rows = x.files.select("fid", T.listed_object(name).alias("o"))
    return rows.select("fid", F.col("o.Key").alias("key"), F.col("o.Size").alias("size"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents", tables=False)
def inflate_text(x: Lens):
    """Every second text as two gzip members, told from the others by their first bytes."""
    @F.pandas_udf("binary")
    def pack(data: pd.Series) -> pd.Series:
        return data.map(lambda b: gzip.compress(b[:9], 1, mtime=0) + gzip.compress(b[9:], 1, mtime=0))

    content = F.when(F.col("doc_id") % 2 == 0, pack("content")).otherwise(F.col("content"))
    return x.file_bytes.select("doc_id", F.md5(cs.inflate(content)).alias("md5"))


@query(""", live AS (SELECT chunk_id, count(*) AS n FROM replicas WHERE server_id IN (SELECT server_id FROM servers WHERE server_id % 7 <> 0) GROUP BY 1)
SELECT c.fid, c.chunk_id, coalesce(n, 0) AS have, num_replicas AS want, CASE WHEN n > 0 THEN 'replication' WHEN num_stripes > 0 THEN 'recovery' ELSE 'pending' END AS state
FROM chunks c JOIN files f ON f.fid = c.fid LEFT JOIN live l ON l.chunk_id = c.chunk_id WHERE coalesce(n, 0) < num_replicas""")
def replication_candidates(x: Lens):
    return pl.short_of_copies(x.chunks, x.files, x.replicas, x.places.filter("server_id % 7 <> 0"))


@query(REBALANCE_SQL + """, w AS (SELECT server_id, to_server, size FROM ok WHERE one = 1), e AS (SELECT server_id, 1 AS o, size FROM w UNION ALL SELECT to_server, 0, size FROM w)
SELECT server_id, count(*) FILTER (o = 1) AS sent, coalesce(sum(size) FILTER (o = 1), 0)::BIGINT AS sent_bytes, count(*) FILTER (o = 0) AS got, coalesce(sum(size) FILTER (o = 0), 0)::BIGINT AS got_bytes FROM e GROUP BY 1""")
def rebalance_counters(x: Lens):
    return pl.plan_counters(pl.plan_round(x.replicas, x.places, VARIATION), x.replicas)


GROUPS_SQL = """, g AS (SELECT r.fid, CASE WHEN num_stripes > 0 AND num_replicas = 1 THEN r.idx // (num_stripes + num_recovery) ELSE r.idx END AS grp, chunk_id, k, r.server_id, rack
FROM replicas r JOIN files f ON f.fid = r.fid JOIN servers s ON s.server_id = r.server_id)"""


@query(GROUPS_SQL + " SELECT fid, grp, rack, count(*) AS copies FROM g GROUP BY ALL HAVING count(*) > 1")
def crowded_racks(x: Lens):
    return pl.crowded_racks(x.files, x.replicas, x.places)


@query(GROUPS_SQL + """, m AS (SELECT * FROM g WHERE server_id % 7 = 3 QUALIFY row_number() OVER (PARTITION BY fid, grp ORDER BY chunk_id, k) = 1),
n AS (SELECT fid, grp, rack, count(*) AS n FROM g WHERE server_id % 7 <> 3 GROUP BY ALL),
t AS (SELECT m.fid, m.grp, m.chunk_id, m.server_id AS from_server, s.server_id AS to_server, coalesce(n, 0) AS beside, (m.chunk_id % 1000003 + s.server_id * 104729) % 1000003 AS h
FROM m CROSS JOIN servers s LEFT JOIN n ON n.fid = m.fid AND n.grp = m.grp AND n.rack = s.rack WHERE s.server_id % 7 <> 3 AND used * 1000000 // total <= 950000),
u AS (SELECT t.* FROM t ANTI JOIN replicas r ON r.chunk_id = t.chunk_id AND r.server_id = t.to_server)
SELECT fid, chunk_id, from_server, to_server, beside FROM u QUALIFY row_number() OVER (PARTITION BY fid, grp ORDER BY beside, (h * h % 1000003 + to_server) * (h * h % 1000003 + 7919) % 1000003, to_server) = 1""")
def evacuation_plan(x: Lens):
    return pl.evacuate(x.files, x.replicas, x.places, x.places.filter("server_id % 7 = 3"), parts=x.parts)


@query(""", live AS (SELECT chunk_id, count(*) AS n FROM replicas WHERE server_id % 7 <> 0 OR server_id < 42 GROUP BY 1)
SELECT c.fid, c.chunk_id, coalesce(n, 0) AS have, num_replicas AS want, CASE WHEN n > 0 THEN 'replication' WHEN num_stripes > 0 THEN 'recovery' ELSE 'pending' END AS state
FROM chunks c JOIN files f ON f.fid = c.fid LEFT JOIN live l ON l.chunk_id = c.chunk_id WHERE coalesce(n, 0) < num_replicas""")
def hibernation_candidates(x: Lens):
    """Chunks to copy anew while servers hibernate: every seventh went down as many minutes ago as its id says, and is waited for 42 minutes."""
    down = x.places.filter("server_id % 7 = 0").select("server_id", (F.lit(NOW_US) - F.col("server_id") * 60_000_000).alias("since"))
    return pl.short_of_copies(x.chunks, x.files, x.replicas, pl.counted(x.places, down, NOW_US, 42 * 60_000_000))


@query("""SELECT upper(op) AS op, CASE WHEN seq % 5 <> 0 THEN uid END AS uid, count(*) AS requests, count(*) FILTER (NOT committed) AS errors, sum(arg)::BIGINT AS args FROM oplog GROUP BY ALL""")
def audit_summary(x: Lens):
    """Requests and errors by kind and user, from the text of an audit log; every fifth request has no user."""
    ops = x.oplog
    uid = F.when(F.col("seq") % 5 != 0, F.col("uid"))
    headers = [("Cseq", F.col("seq")), ("Arg", F.col("arg")), ("Status", F.lit("sent: by a client"))]
    text = audit_text.record(F.upper("op"), headers, F.concat(F.lit("10.0.0."), F.col("uid") % 256), uid, F.when(F.col("committed"), 0).otherwise(-5))
    rows = audit_text.parse(ops.select(text.alias("value")))
    return rows.groupBy("op", "uid").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") < 0).alias("errors"), F.sum(F.col("headers")["Arg"].cast("long")).alias("args"))


@query(""", w AS (SELECT server, count(*) AS samples, sum(value)::BIGINT AS total, max(value) AS highest FROM samples GROUP BY 1)
SELECT server::VARCHAR AS server, counter, value FROM (UNPIVOT w ON samples, total, highest INTO NAME counter VALUE value)""")
def counters_long(x: Lens):
    """A row for each server's counter, from one with all of them."""
    wide = x.samples.groupBy("server").agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.max("value").alias(" highest "))
    return counters_csv.long_form(wide, "server")
