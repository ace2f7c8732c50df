"""Queries on stripes and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reed_solomon as rs
from ..lens import Lens
from ..operators import stripes
from .catalog import query

#: Bytes by file, column and position; t0 has each byte doubled k times.
BYTES_SQL = """WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, ('0x' || h[2*i+1:2*i+2])::BIGINT AS v FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM d)),
z AS (SELECT doc_id, greatest(1, (len(h) // 2 + 383) // 384) * 64 AS w FROM d),
u AS (SELECT doc_id, (i // 64) % 6 AS j, i // 384 * 64 + i % 64 AS pos, v FROM b)
"""

PARITY_SQL = (
    BYTES_SQL
    + """, t0 AS (SELECT 0 AS k, v, v AS y FROM range(256) r(v) UNION ALL SELECT k + 1, v, xor((y << 1) & 255, CASE WHEN y & 128 <> 0 THEN 29 ELSE 0 END) FROM t0 WHERE k < 10),
x AS (SELECT u.doc_id, pos, bit_xor(u.v) AS p, bit_xor(a.y) AS q, bit_xor(c.y) AS r FROM u JOIN t0 a ON a.k = u.j AND a.v = u.v JOIN t0 c ON c.k = 2 * u.j AND c.v = u.v GROUP BY u.doc_id, pos),
f AS (SELECT z.doc_id, g AS pos FROM (SELECT doc_id, unnest(range(w)) AS g FROM z) z),
s AS (SELECT f.doc_id, string_agg(printf('%02x', coalesce(p, 0)), '' ORDER BY pos) AS p, string_agg(printf('%02x', coalesce(q, 0)), '' ORDER BY pos) AS q, string_agg(printf('%02x', coalesce(r, 0)), '' ORDER BY pos) AS r
FROM f LEFT JOIN x USING (doc_id, pos) GROUP BY f.doc_id)
SELECT doc_id, md5(unhex(p)) AS p, md5(unhex(q)) AS q, md5(unhex(r)) AS r FROM s"""
)


@query(PARITY_SQL, tables=False)
def rs_encode(x: Lens):
    return stripes.parity_digests(x.file_bytes)


@query("SELECT doc_id, md5(coalesce(text, '')) AS before, true AS same, (1 + doc_id % 3)::INTEGER AS recovered FROM documents", tables=False)
def rs_repair(x: Lens):
    """Columns are taken away from each file by its number, up to three, and the file comes back."""
    every = stripes.encode(x.file_bytes)
    idx, doc = F.col("idx"), F.col("doc_id")
    gone = (idx == doc % 9) | ((doc % 3 >= 1) & (idx == (doc + 4) % 9)) | ((doc % 3 >= 2) & (idx == (doc + 7) % 9))
    back = stripes.repair(every.filter(~gone))
    size = F.octet_length("content")
    rows = back.withColumnRenamed("content", "back").join(x.file_bytes, "doc_id")
    return rows.select("doc_id", F.md5("content").alias("before"), (F.md5("content") == F.md5(F.substr("back", F.lit(1), size))).alias("same"), "recovered")


@query("SELECT * FROM (VALUES ('none', 0, 0), ('rs', 64, 3)) t(codec, most_data, parity)", tables=False)
def ecinfo(x: Lens):
    return x.spark.createDataFrame([(k, n, m) for k, (n, m) in rs.CODECS.items()], "codec string, most_data int, parity int")
