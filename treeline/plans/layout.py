"""Queries on chunks, replicas and stripes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CHUNK
from ..lens import Lens
from ..operators import layout as lay
from ..storage import small
from .catalog import query

@query("""SELECT chunk_id, "offset", version, coalesce((SELECT string_agg(server_id::VARCHAR, ',' ORDER BY server_id) FROM replicas r WHERE r.chunk_id = c.chunk_id), '') AS servers,
(SELECT count(*) > 2 FROM chunks WHERE fid = 1000000007 AND "offset" >= 67108864) AS has_more
FROM chunks c WHERE fid = 1000000007 AND "offset" >= 67108864 ORDER BY "offset" LIMIT 2""")
def getlayout(x: Lens):
    return lay.layout_page(x.chunks, x.replicas, 1000000007, CHUNK, 2)


@query("SELECT fid, chunk_id, idx, \"offset\", version, c.size FROM chunks c JOIN files USING (fid)")
def file_chunks(x: Lens):
    return x.files.select("fid").join(x.chunks, "fid").select("fid", "chunk_id", "idx", "offset", "version", "size")


@query("SELECT chunk_id, k, host, port, rack, version FROM replicas JOIN servers USING (server_id)")
def chunk_locations(x: Lens):
    s = x.places.drop("total")
    return x.replicas.join(small(s), "server_id").select("chunk_id", "k", "host", "port", "rack", "version")


@query("""SELECT fid, max(chunk_id) AS chunk_id, max("offset") AS "offset" FROM chunks GROUP BY fid""")
def last_chunk(x: Lens):
    return lay.last_chunks(x.chunks)


@query("""SELECT f.fid, f.size // 2 AS pos, c.chunk_id FROM files f JOIN chunks c ON c.fid = f.fid AND c."offset" <= f.size // 2 AND f.size // 2 < c."offset" + 67108864""")
def chunk_at_pos(x: Lens):
    at = x.files.select("fid", F.expr("size div 2").alias("pos")).withColumn("block", lay.div(F.col("pos"), CHUNK))
    return at.join(x.chunks.select("fid", lay.div(F.col("offset"), CHUNK).alias("block"), "chunk_id"), ["fid", "block"]).select("fid", "pos", "chunk_id")


@query("""SELECT f.fid, f.a AS start, c.chunk_id, greatest(a, c."offset") AS begin, least(a + n, c."offset" + 67108864) - greatest(a, c."offset") AS length, server_id
FROM (SELECT fid, size // 3 AS a, size // 2 AS n FROM files) f JOIN chunks c ON c.fid = f.fid AND c."offset" < a + n AND c."offset" + 67108864 > a JOIN replicas r ON r.chunk_id = c.chunk_id WHERE n > 0""")
def data_location(x: Lens):
    ranges = x.files.selectExpr("fid", "size div 3 AS start", "size div 2 AS length")
    return lay.byte_ranges(ranges, x.chunks, x.replicas)


@query("""SELECT c.chunk_id, c.fid, count(server_id) AS n, coalesce(string_agg(host || ' ' || port || ' ' || rack, ' ' ORDER BY k), '') AS locations
FROM chunks c LEFT JOIN replicas r ON r.chunk_id = c.chunk_id LEFT JOIN servers USING (server_id) GROUP BY c.chunk_id, c.fid""")
def chunkmap_dump(x: Lens):
    from ..sources.chunkmap import dump

    s = x.places.drop("total")
    return dump(x.chunks, x.replicas, s)


@query("""SELECT fid, pos, pos // (67108864 * n) AS block, (pos % (67108864 * n) // s) % n AS stripe,
(pos // (67108864 * n)) * 67108864 * (n + m) + ((pos % (67108864 * n)) // (s * n)) * s + ((pos % (67108864 * n) // s) % n) * 67108864 + pos % (67108864 * n) % s AS physical
FROM (SELECT fid, size // 2 + fid % 1000 AS pos, num_stripes AS n, num_recovery AS m, stripe_size AS s FROM files WHERE num_stripes > 0)""")
def stripe_map(x: Lens):
    rows = x.files.filter("num_stripes > 0").withColumn("pos", F.expr("size div 2 + fid % 1000"))
    return rows.select("fid", "pos", *[c.alias(k) for k, c in lay.stripe_position(F.col("pos"), F.col("num_stripes"), F.col("num_recovery"), F.col("stripe_size")).items()])


@query("""SELECT fid, idx, CASE WHEN rest <= 0 OR rest >= 134217728 THEN 67108864 ELSE rest // 131072 * 65536 +
CASE WHEN i < rest % 131072 // 65536 THEN 65536 WHEN i = rest % 131072 // 65536 THEN rest % 131072 % 65536 ELSE 0 END END AS expected
FROM (SELECT fid, idx, CASE WHEN idx < 2 THEN idx ELSE 0 END AS i, size - block * 134217728 AS rest FROM
(SELECT fid, size, unnest(range(3)) AS idx, unnest([size // 134217728, size // 134217728, size // 134217728]) AS block FROM files WHERE num_stripes > 0))""")
def stripe_chunk_size(x: Lens):
    rows = x.files.filter("num_stripes > 0").withColumn("idx", F.explode(F.expr("sequence(0L, num_stripes + num_recovery - 1)")))
    block_pos = F.expr(f"size div ({CHUNK} * num_stripes) * {CHUNK} * num_stripes")
    return rows.select("fid", "idx", lay.stripe_chunk_size(F.col("idx"), block_pos, F.col("size"), F.col("num_stripes"), F.col("stripe_size")).alias("expected"))


@query(""", lc AS (SELECT fid, max(chunk_id) AS chunk_id, max("offset") AS o FROM chunks GROUP BY fid),
held AS (SELECT chunk_id, max(size) AS s FROM replicas WHERE size > 0 GROUP BY chunk_id)
SELECT f.fid, CASE WHEN f.fid % 5 <> 0 THEN f.size WHEN lc.fid IS NULL THEN 0 ELSE o + coalesce(s, 67108864) END AS size
FROM files f LEFT JOIN lc ON lc.fid = f.fid LEFT JOIN held ON held.chunk_id = lc.chunk_id""")
def compute_filesize(x: Lens):
    unknown = x.files.select("fid", F.when(F.col("fid") % 5 == 0, -F.col("size") - 1).otherwise(F.col("size")).alias("size"))
    return lay.effective_size(unknown, x.chunks, x.replicas)


@query("""SELECT c.fid, min(n) AS least, max(n) AS most, greatest(any_value(chunk_count), count(*)) AS chunks FROM
(SELECT c.fid, c.chunk_id, count(r.k) AS n FROM chunks c LEFT JOIN replicas r ON r.chunk_id = c.chunk_id GROUP BY ALL) c JOIN files USING (fid) GROUP BY c.fid""")
def replication_minmax(x: Lens):
    """A chunk that no copy of is listed counts as none: those are the chunks that a file has over those with copies."""
    held = x.replicas.groupBy("fid", "chunk_id").agg(F.count(F.lit(1)).alias("n")).groupBy("fid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("held"))
    per_file = x.chunks.groupBy("fid").agg(F.count(F.lit(1)).alias("listed")).join(held, "fid", "left").join(x.files.select("fid", "chunk_count"), "fid")
    least = F.when(F.col("held") == F.col("listed"), F.col("lo")).otherwise(F.lit(0)).cast("long")
    return per_file.select("fid", least.alias("least"), F.coalesce("hi", F.lit(0)).cast("long").alias("most"), F.greatest("chunk_count", "listed").alias("chunks"))


@query("""SELECT fid, unnest(range(0, size, 67108864)) AS "offset" FROM files WHERE size > 0""")
def objstore_layout(x: Lens):
    return lay.object_blocks(x.files)


@query("""SELECT chunk_id, k, server_id, version <> v AS version_differs, size <> s AS size_differs, size <= 0 AS no_size FROM
(SELECT *, coalesce(lag(version) OVER w, version) AS v, coalesce(lag(size) OVER w, size) AS s FROM replicas WINDOW w AS (PARTITION BY chunk_id ORDER BY server_id, k))""")
def block_enum(x: Lens):
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy("server_id", "k")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    return x.replicas.select("chunk_id", "k", "server_id", (F.col("version") != before("version")).alias("version_differs"), (F.col("size") != before("size")).alias("size_differs"), (F.col("size") <= 0).alias("no_size"))


@query("SELECT * FROM (VALUES (1, 0, 3, 200::BIGINT), (6, 3, 1, 50::BIGINT), (1, 0, 2, 100::BIGINT)) t(data, recovery, copies, overhead_percent)", tables=False)
def space_overhead(x: Lens):
    rows = x.spark.createDataFrame([(1, 0, 3), (6, 3, 1), (1, 0, 2)], "data int, recovery int, copies int")
    return rows.withColumn("overhead_percent", F.expr("((data + recovery) * copies - data) * 100L div data"))
