"""Queries on bytes, checksums, paths and text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import checksums as cs
from ..functions import text as T
from ..lens import Lens, micros
from .catalog import query

BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, len(h) // 2 AS n, ('0x' || h[2*i+1:2*i+2])::BIGINT AS v FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM d))
"""
ADLER = "(((sum({n} * 1::HUGEINT) * 0 + any_value({n}) + sum(({n} - {i}) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT"


@query(BYTES + f"SELECT d.doc_id, coalesce(a, 1) AS adler FROM d LEFT JOIN (SELECT doc_id, {ADLER.format(n='n', i='i')} AS a FROM b GROUP BY doc_id) USING (doc_id)", tables=False)
def adler32(x: Lens):
    return x.file_bytes.select("doc_id", cs.adler32("content").alias("adler"))


@query(BYTES + f", k AS (SELECT doc_id, i // 1024 AS block, {ADLER.format(n='least(1024, n - i // 1024 * 1024)', i='i % 1024')} AS a FROM b GROUP BY doc_id, i // 1024) SELECT doc_id, block, a AS adler FROM k", tables=False)
def block_checksums(x: Lens):
    rows = x.file_bytes.select("doc_id", F.posexplode(cs.block_adler32(1024)("content")).alias("block", "adler"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), "adler")


@query(BYTES + f"SELECT d.doc_id, coalesce(a, 1) AS adler, true AS same FROM d LEFT JOIN (SELECT doc_id, {ADLER.format(n='n', i='i')} AS a FROM b GROUP BY doc_id) USING (doc_id)", tables=False)
def adler32_combine(x: Lens):
    """The whole from its two halves."""
    half = F.call_function("div", F.octet_length("content"), F.lit(2)).cast("int")
    rows = x.file_bytes.withColumns({"a": F.substr("content", F.lit(1), half), "b": F.substr("content", half + 1, F.octet_length("content"))})
    whole = cs.adler32_combine(cs.adler32("a"), cs.adler32("b"), F.octet_length("b").cast("long"))
    return rows.select("doc_id", whole.alias("adler"), (whole == cs.adler32("content")).alias("same"))


@query("SELECT doc_id, doc_id * 10007 AS \"offset\", doc_id * 10007 // 65536 AS block, doc_id * 10007 // 65536 * 65536 AS start, (doc_id * 10007 // 65536 + 1) * 65536 AS \"end\" FROM documents", tables=False)
def checksum_block_geometry(x: Lens):
    rows = x.table("documents").select("doc_id", (F.col("doc_id") * 10007).alias("offset"))
    return rows.select("doc_id", "offset", *[c.alias(k) for k, c in cs.block_geometry(F.col("offset")).items()])


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, md5(md5(coalesce(text, ''))) AS nested FROM documents", tables=False)
def md5_lines(x: Lens):
    return x.file_bytes.select("doc_id", F.md5("content").alias("md5"), F.md5(F.md5("content")).alias("nested"))


# The register after a message is linear in its bytes: each adds what ``distance`` more steps make of its bits.  So the
# SQL sums by XOR, and shares nothing with a loop over a table of bytes.
CRC_STEPS = """, e8 AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM e8 WHERE k < 8),
e AS (SELECT list(v ORDER BY i) AS t FROM e8 WHERE k = 8),
p AS (SELECT 0 AS distance, [1, 2, 4, 8, 16, 32, 64, 128, 4294967295]::BIGINT[] AS x UNION ALL SELECT distance + 1, list_transform(x, lambda s: xor(s >> 8, e.t[(s & 255) + 1])) FROM p, e WHERE distance < {most})"""
CRC_SUM = "bit_xor(xor(xor(xor(v % 2 * x[1], v // 2 % 2 * x[2]), xor(v // 4 % 2 * x[3], v // 8 % 2 * x[4])), xor(xor(v // 16 % 2 * x[5], v // 32 % 2 * x[6]), xor(v // 64 % 2 * x[7], v // 128 * x[8]))))"


@query(BYTES.replace("WITH", "WITH RECURSIVE") + CRC_STEPS.format(most="(SELECT max(len(h)) // 2 FROM d)") + f""", s AS (SELECT doc_id, {CRC_SUM} AS s FROM b JOIN p ON distance = n - i GROUP BY doc_id)
SELECT d.doc_id, xor(xor(coalesce(s, 0), x[9]), 4294967295)::BIGINT AS crc FROM d JOIN p ON distance = len(h) // 2 LEFT JOIN s USING (doc_id)""", tables=False)
def crc32(x: Lens):
    return x.file_bytes.select("doc_id", F.crc32("content").alias("crc"))


@query("SELECT doc_id, CASE WHEN len(h) <= 2048 THEN h ELSE h[len(h)-2047:] END AS tail FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)", tables=False)
def tail_bytes(x: Lens):
    return x.file_bytes.select("doc_id", F.hex(F.when(F.octet_length("content") > 1024, F.substring("content", -1024, 1024)).otherwise(F.col("content"))).alias("tail"))


@query(r"""SELECT page_id, '/' || array_to_string(list_filter(string_split(p, '/'), lambda s: s <> '' AND s <> '.'), '/') AS path, parse_filename(rtrim(p, '/')) AS base
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+:/*', '//'), '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '//x/./y' WHEN 1 THEN '/z/' ELSE '' END AS p FROM pages)""", tables=False)
def normalize_path(x: Lens):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+:/*", "//"), "[?#].*$", "")
    p = F.concat(p, F.when(F.col("page_id") % 3 == 0, "//x/./y").when(F.col("page_id") % 3 == 1, "/z/").otherwise(""))
    return x.table("pages").select("page_id", T.normalize_path(p).alias("path"), T.basename(p).alias("base"))


@query("SELECT n, '/' || CASE n % 3 WHEN 0 THEN 'a/c' WHEN 1 THEN 'd' ELSE '' END AS path FROM range(100) t(n)", tables=False)
def normalize_dots(x: Lens):
    p = F.expr("CASE id % 3 WHEN 0 THEN '/a/b/../c' WHEN 1 THEN '/../../d/' ELSE '//./x/..' END")
    return x.spark.range(100).select(F.col("id").alias("n"), T.normalize_path(p).alias("path"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events""", tables=False)
def iso_micros(x: Lens):
    return x.table("events").select("event_id", T.iso_micros(micros("ts")).alias("iso"))


@query("""SELECT event_id, regexp_extract(props, '"k": *([0-9-]+)', 1) AS k FROM events""", tables=False)
def parse_props(x: Lens):
    flat = F.regexp_replace("props", '[{}" ]', "")
    return x.table("events").select("event_id", F.coalesce(F.element_at(F.str_to_map(flat, F.lit(","), F.lit(":")), "k"), F.lit("")).alias("k"))


def _name_hash_sql() -> str:
    m = 4294967295
    left = lambda h, n: f"xor({h}, ({h} << {n}) & {m})"
    right = lambda h, n: f"(({h} + ({h} >> {n})) & {m})"
    signed = "(b[n] - b[n] // 128 * 256)"
    pair = f"xor(xor(((h + w % 65536) & {m}) << 16, w // 65536 << 11), (h + w % 65536) & {m}) & {m}"
    return f""", n0 AS (SELECT parent, name, fid, len(h) // 2 AS n, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT) AS b FROM (SELECT parent, name, fid, hex(encode(name)) AS h FROM fattr)),
n1 AS (SELECT *, n % 4 AS r, list_reduce(list_transform(range(n // 4), lambda i: b[4*i+1] + b[4*i+2] * 256 + b[4*i+3] * 65536 + b[4*i+4] * 16777216), lambda h, w: {right(f"({pair})", 11)}, n) AS h FROM n0),
n2 AS (SELECT * REPLACE (CASE WHEN r >= 2 THEN (h + b[n - r + 1] + b[n - r + 2] * 256) & {m} WHEN r = 1 THEN (h + {signed}) & {m} ELSE h END AS h) FROM n1),
n3 AS (SELECT * REPLACE (CASE r WHEN 3 THEN xor({left("h", 16)}, ({signed} * 262144) & {m}) WHEN 2 THEN {left("h", 11)} WHEN 1 THEN {left("h", 10)} ELSE h END AS h) FROM n2),
n4 AS (SELECT * REPLACE (CASE r WHEN 3 THEN {right("h", 11)} WHEN 2 THEN {right("h", 17)} WHEN 1 THEN {right("h", 1)} ELSE h END AS h) FROM n3),
n5 AS (SELECT * REPLACE ({right(left("h", 3), 5)} AS h) FROM n4), n6 AS (SELECT * REPLACE ({right(left("h", 4), 17)} AS h) FROM n5), n7 AS (SELECT * REPLACE ({right(left("h", 25), 6)} AS h) FROM n6)
SELECT parent, name, fid, (CASE WHEN n = 0 THEN 0 ELSE h END)::BIGINT AS hash, ((CASE WHEN n = 0 THEN 0 ELSE h END)::BIGINT * 16)::BIGINT AS key FROM n7"""


@query(_name_hash_sql())
def name_hash_order(x: Lens):
    """Directory entries in the order of their name hash, ties by name."""
    rows = x.fattr.select("parent", "name", "fid").withColumn("hash", cs.name_hash("name"))
    return rows.withColumn("key", cs.directory_order(F.col("hash"))).orderBy("parent", "hash", "name")


def _safe_sql(value: str, size: int) -> str:
    """The low ``size`` bytes of a number, least first, in base 64 for URLs."""
    digits = " || ".join(f"printf('%02x', ({value} >> {8 * i}) & 255)" for i in range(size))
    return f"replace(replace(rtrim(to_base64(unhex({digits})), '='), '+', '-'), '/', '_')"


@query(CRC_STEPS.format(most=16) + f""", c AS (SELECT fid, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN -version ELSE version END AS ver FROM chunks),
y AS (SELECT chunk_id, 16 - i AS dist, ((CASE WHEN i < 8 THEN chunk_id ELSE ver END) >> (i % 8 * 8)::BIGINT) & 255 AS v FROM (SELECT *, unnest(range(16)) AS i FROM c WHERE ver < 0)),
s AS (SELECT chunk_id, xor(xor({CRC_SUM}, (SELECT x[9] FROM p WHERE distance = 16)), 4294967295)::BIGINT AS crc FROM y JOIN p ON distance = dist GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN ver >= 0 THEN '' ELSE {_safe_sql("crc", 4)} || '.' END || fid || '.' || chunk_id || '.' || ver || CASE WHEN ver >= 0 THEN '' ELSE '.' || {_safe_sql("7700000001", 7)} END AS key FROM c LEFT JOIN s USING (chunk_id)""")
def object_key(x: Lens):
    c = x.chunks.select("fid", "chunk_id", F.when(F.col("chunk_id") % 2 == 0, -F.col("version")).otherwise(F.col("version")).alias("version"))
    return c.select("chunk_id", cs.object_key(F.lit(7_700_000_001).cast("long") + F.col("fid") * 0, "fid", "chunk_id", "version").alias("key"))


@query("""SELECT doc_id, text AS back, replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), '=', '%3D'), ';', '%3B'), '/', '%2F'), ',', '%2C'), chr(10), '%0A'), chr(9), '%09'), chr(13), '%0D') AS escaped
FROM documents WHERE text IS NOT NULL""", tables=False)
def escape_round_trip(x: Lens):
    hidden = cs.escape("text")
    return x.documents.filter("text IS NOT NULL").select("doc_id", cs.unescape(hidden).alias("back"), hidden.alias("escaped"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND coalesce(text, '') <> '' THEN 'checksum mismatch in block 0' ELSE 'ok' END AS result FROM documents", tables=False)
def scrub(x: Lens):
    """Chunk files made of the documents, one in seven damaged, and what the scrubber says of each."""
    @F.pandas_udf("binary")
    def build(doc: pd.Series, content: pd.Series) -> pd.Series:
        out = [bytearray(cs.chunk_file(1, int(d), 1, c)) for d, c in zip(doc, content, strict=True)]
        for d, b in zip(doc, out, strict=True):
            if d % 7 == 0 and len(b) > cs.HEADER_SIZE:
                b[cs.HEADER_SIZE] ^= 1
        return pd.Series([bytes(b) for b in out])

    rows = x.file_bytes.withColumn("file", build("doc_id", "content"))
    return rows.select("doc_id", cs.scrub(F.concat(F.lit("/c/1."), F.col("doc_id").cast("string"), F.lit(".1")), "file").alias("result"))
