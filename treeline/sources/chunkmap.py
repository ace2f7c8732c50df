"""Text of chunk maps, server lists and rebalance plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dump(chunks: DataFrame, replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """(chunk_id, fid, n, locations): host, port and rack of each copy."""
    place = F.concat_ws(" ", "host", F.col("port").cast("string"), F.col("rack").cast("string"))
    held = replicas.select("chunk_id", "k", "server_id").join(servers, "server_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("k", place.alias("place")))).alias("copies"))
    rows = chunks.select("chunk_id", "fid").join(held, "chunk_id", "left")
    return rows.select("chunk_id", "fid", F.coalesce(F.size("copies"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("copies.place", " "), F.lit("")).alias("locations"))


def write_chunk_map(dumped: DataFrame, path: str) -> None:
    """Lines ``chunk file n {host port rack}*``."""
    dumped.select(F.rtrim(F.concat_ws(" ", "chunk_id", "fid", "n", "locations")).alias("value")).write.text(path)


def read_chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, fid, k, host, port, rack); a chunk without copies has one row of nulls."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"))
    n = F.get("w", F.lit(2)).cast("int")
    copies = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    part = lambda i: F.get("w", F.lit(3 + i) + 3 * F.col("k"))
    rows = t.select("w", F.explode_outer(copies).alias("k"))
    return rows.select(F.get("w", F.lit(0)).cast("long").alias("chunk_id"), F.get("w", F.lit(1)).cast("long").alias("fid"), "k", part(0).alias("host"), part(1).cast("long").alias("port"), part(2).cast("long").alias("rack"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Servers: lines ``host port rack total used``."""
    return spark.read.csv(path, sep=" ", schema="host string, port long, rack long, total long, used long")


def write_plan(plan: DataFrame, path: str) -> None:
    """Lines ``chunk host port``."""
    plan.select("chunk_id", "host", "port").write.csv(path, sep=" ")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="chunk_id long, host string, port long")
