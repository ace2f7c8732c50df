"""WARC archives that store each payload once.

Writing: a payload is named by its SHA-256 digest.  Of the records with equal
payloads, the one with the largest id becomes the response that holds the bytes;
the others are revisits that refer to it.  Files are WARC 1.1, one gzip member to
a record, and end once they have ``FILE_BYTES`` or more.  Spark's text writer
writes the bytes, so the files are named .txt; what it puts at a file's end is an
empty gzip member.

Reading: members are inflated one by one, never a whole file, and records are
parsed by their lengths.  A response's payload is hashed again; its SHA-256 and
SHA-1 must agree with its header.  Exact headers, of WARC and of HTTP, are one
table and payloads, by SHA-256, another; pages, and the bytes of each record, come
back by joining the two.  Two payloads of one SHA-1 stay two.

Edge cases: a null or empty payload has 0 bytes and is a payload like others.  A
record with a null id is always a response.  Of rows that repeat the largest id
with one payload but several addresses, one is the response.  Rows equal in id,
address and payload are one record that is written as often as they come.  A null
address is an empty one; line breaks in addresses are written as %0D and %0A.  An
empty table gives an archive without records.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: A file ends with the record that brings it to so many compressed bytes.
FILE_BYTES = 16_000_000
#: Records come out of a reader in batches of about so many bytes.
BATCH_BYTES = 4_000_000
#: Compressed bytes that are inflated at once.
STEP = 16_384
NOTHING = gzip.compress(b"", mtime=0)
HEADERS = "id long, record_type string, refers_to long, url string, digest string, strong string, header binary, http binary, n_bytes long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: each 5 hex digits are 4 characters."""
    digest = F.sha1(data)
    chars = []
    for k in range(8):
        part = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for j in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(BASE32), F.shiftright(part, j).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*chars)


def revisits(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """``pages`` (id, url, payload) with ``strong``, ``n_bytes``, ``name`` of the record, and ``owner`` and
    ``owner_name`` of the response with the same payload.

    Payloads of fewer than ``smallest`` bytes are all responses.  The bytes are
    moved once, by id; what is grouped are digests, combined before they shuffle.
    """
    data = pages.withColumns({"strong": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    data = data.withColumn("name", F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "strong", "url"), 256))
    own = data.filter(F.col("id").isNotNull() & (F.col("n_bytes") >= smallest)).select("id", "strong", "name")
    largest = own.groupBy("strong").agg(F.max(F.struct("id", "name")).alias("x")).select("strong", F.col("x.id").alias("owner"), F.col("x.name").alias("owner_name"))
    decided = own.select("id", "strong").join(largest, "strong").distinct()
    return data.join(decided, ["id", "strong"], "left")


def _urn(name: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(name, i, n) for i, n in cuts]), F.lit(">"))


def records(pages: DataFrame, smallest: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): the bytes of each WARC record."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = revisits(pages.withColumn("url", url), smallest)
    again = F.coalesce(F.col("owner_name") != F.col("name"), F.lit(False))
    number = lambda field, c: F.when(c.isNotNull(), F.concat(F.lit(f"\r\n{field}: "), c.cast("string"))).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    size = F.length("http") + F.when(again, 0).otherwise(F.col("n_bytes"))
    refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("owner_name")), number("X-Refers-To-Page", F.col("owner")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("name")), number("X-Page", F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")), F.lit("\r\nX-Payload-Digest: sha256:"), F.col("strong"),
        F.when(again, refers).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END),
    )
    text = F.concat(head, F.col("http"), F.when(again, "").otherwise(F.col("payload")), F.lit(END))
    return rows.withColumn("http", http).select(text.cast("binary").alias("value"))


def _pack(batches):
    """Each row is a file: gzip members of records, up to the one that makes it long enough."""
    parts, size = [], 0
    out = lambda: pa.record_batch([pa.array([b"".join(parts)], pa.binary())], ["value"])
    for b in batches:
        for value in b.column(0):
            parts.append(gzip.compress(value.as_buffer(), 6, mtime=0))
            size += len(parts[-1])
            if size >= FILE_BYTES:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> None:
    small_batches(df.sparkSession)
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    files = records(pages, smallest).mapInArrow(tidy(_pack), "value binary").select(F.col("value").cast("string"))
    # The bytes are written as they are; a text of one row to a file has no other line end than the last.
    out = files.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1"))
    out.option("maxRecordsPerFile", 1).text(path)


def members(content: memoryview):
    """The inflated gzip members of a file, one by one.

    A member is fed in steps, as what lies beyond its end is copied.
    """
    at = 0
    while at < len(content):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = content[at : at + STEP]
            if not piece:
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        if out := b"".join(parts):
            yield out


def parse(data: bytes):
    """(exact header, fields, exact HTTP header, payload) of each record in inflated data."""
    at, end = 0, END.encode()
    while at < len(data):
        body = data.index(end, at) + 4
        header = data[at:body]
        fields = dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:] if line)
        stop = body + int(fields["Content-Length"])
        if not header.startswith(b"WARC/1.") or data[stop : stop + 4] != end:
            raise ValueError("this is no WARC record")
        start = data.index(end, body, stop) + 4
        yield header, fields, data[body:start], data[start:stop]
        at = stop + 4


def _verified(header: bytes, f: dict, http: bytes, payload: bytes) -> tuple:
    full = f["WARC-Type"] == "response"
    digest, strong = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["X-Payload-Digest"].removeprefix("sha256:")
    if full and (hashlib.sha256(payload).hexdigest() != strong or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {f['WARC-Record-ID']} does not have its digest")
    page, other = (None if f.get(k) is None else int(f[k]) for k in ("X-Page", "X-Refers-To-Page"))
    return page, f["WARC-Type"], other, f["WARC-Target-URI"], digest, strong, header, http, len(payload) if full else None, payload if full else None


def _read(with_payload: bool):
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    names = ["id", "record_type", "refers_to", "url", "digest", "strong", "header", "http", "n_bytes", "payload"]
    n = len(names) - (not with_payload)

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names[:n])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for content in b.column(0):
                for data in members(memoryview(content.as_buffer())):
                    for record in parse(data):
                        rows.append(_verified(*record)[:n])
                        size += len(record[0]) + len(record[2]) + (len(record[3]) if with_payload else 200)
                        if size >= BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Exact headers of all records, each response's size (and bytes), verified by its digests."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(tidy(_read(with_payload)), HEADERS + (", payload binary" if with_payload else ""))


def payloads(archive: DataFrame) -> DataFrame:
    """(strong, n_bytes, payload if there): every payload once, by its verified SHA-256."""
    held = [c for c in ("n_bytes", "payload") if c in archive.columns]
    return archive.filter("record_type = 'response'").groupBy("strong").agg(*[F.first(c).alias(c) for c in held])


def reconstruct(archive: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Every record with the size, and bytes if there, of its whole payload: headers joined with ``store`` by SHA-256.

    With payloads, ``record`` has the exact bytes of the record as it was written, without the two line ends that close it.
    """
    out = archive.drop("n_bytes", "payload").join(payloads(archive) if store is None else store, "strong", "left")
    if "payload" not in out.columns:
        return out
    held = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.withColumn("record", F.concat("header", "http", held))
