"""Audit logs: a record for each request, ended by a zero character, of header lines ended by CR LF.

The first line names the request; then follow its headers as they came, and
``Client-ip``, ``Auth-uid`` (where the user is known) and ``Status`` (negative for errors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\0"


def record(op: Column, headers: list[tuple[str, Column]], client: Column, uid: Column, status: Column) -> Column:
    """The text of a record; a header or user that is null has no line."""
    lines = [*headers, ("Client-ip", client), ("Auth-uid", uid), ("Status", status)]
    return F.concat_ws("\r\n", op, *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in lines])


def write(records: DataFrame, path: str) -> None:
    """Write (value) as a log."""
    records.select("value").write.option("lineSep", END).text(path)


def parse(records: DataFrame) -> DataFrame:
    """(op, client, uid, status, headers) of (value).

    The last of repeated headers counts, as what the server adds comes last.  A null or empty record is left out; one
    without a status has a null status, and text that is no number is null.
    """
    lines = F.split("value", "\r\n")
    pairs = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.contains(x, F.lit(": ")))
    known = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), _last))
    rows = records.filter("value <> ''").select(F.get(lines, F.lit(0)).alias("op"), known.alias("headers"))
    number = lambda k: F.try_element_at("headers", F.lit(k)).try_cast("long")
    return rows.select("op", F.try_element_at("headers", F.lit("Client-ip")).alias("client"), number("Auth-uid").alias("uid"), number("Status").alias("status"), "headers")


def _last(pairs: Column, line: Column) -> Column:
    """``pairs`` with that of a line, in place of one of the same key."""
    key = F.substring_index(line, ": ", 1)
    value = F.substring(line, F.length(key) + 3, F.length(line))
    return F.array_append(F.filter(pairs, lambda p: p["key"] != key), F.struct(key.alias("key"), value.alias("value")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.option("lineSep", END).text(path))
