"""A deterministic view of the star schema as the tables of a file store.

Every table is a DataFrame of whole source tables.  Chunks, files and replicas are
what queries join most: line items and orders are exchanged by file id, into as many
partitions as their size asks for, and all three are computed within these.  Nothing
is written, so a query moves the columns and rows that it needs alone.
``SQL_TABLES`` says the same in DuckDB's SQL, for the oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import CHUNK
from .storage import parts_for, size_of, small_batches


def micros(column: str):
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


class Lens:
    #: Levels from a file up to the root.
    DEPTH = 4

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Partitions by file id."""
        return parts_for(self.spark, size_of(self.spark, f"{self.sf_dir}/lineitem.parquet"))

    @cached_property
    def dirs(self) -> DataFrame:
        root = self.spark.range(1).selectExpr("2L AS fid", "2L AS parent", "'/' AS name")
        region = self.table("region").selectExpr("10L + r_regionkey AS fid", "2L AS parent", "r_name AS name")
        nation = self.table("nation").selectExpr("100L + n_nationkey AS fid", "10L + n_regionkey AS parent", "n_name AS name")
        customer = self.table("customer").selectExpr("1000000L + c_custkey AS fid", "100L + c_nationkey AS parent", "c_name AS name")
        return root.union(region).union(nation).union(customer)

    @cached_property
    def chunks(self) -> DataFrame:
        # What follows in the order of the SQL makes no difference to a chunk.
        order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
        c = self.table("lineitem").select((F.lit(1000000000).cast("long") + F.col("l_orderkey")).alias("fid"), *order).repartition(self.parts, "fid")
        c = c.withColumn("idx", F.row_number().over(Window.partitionBy("fid").orderBy(*order)).cast("long") - 1)
        size = f"cast(round(l_extendedprice * 100) AS bigint) % {CHUNK + 1}"
        return c.selectExpr(
            "fid", "idx", "fid * 1000 + idx AS chunk_id", f"idx * {CHUNK} AS offset",
            "1 + l_partkey % 7 AS version", f"{size} AS size", "l_suppkey AS suppkey",
        )

    @cached_property
    def files(self) -> DataFrame:
        """Attributes of files; sizes and chunk counts from their chunks."""
        per_file = self.chunks.groupBy("fid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        size = F.when((F.col("fid") - 1000000000) % 97 == 0, F.lit(0)).otherwise(F.coalesce("bytes", F.lit(0))).cast("long")
        return self.attributes.repartition(self.parts, "fid").join(per_file, "fid", "left").withColumn("size", size).withColumn("chunk_count", F.coalesce("n", F.lit(0)).cast("long")).drop("bytes", "n")

    @cached_property
    def attributes(self) -> DataFrame:
        """What files have without their chunks."""
        o = self.table("orders").withColumn("mtime", micros("o_orderdate"))
        return o.selectExpr(
            "1000000000L + o_orderkey AS fid", "1000000L + o_custkey AS parent", "concat('o', o_orderkey) AS name",
            "CASE WHEN o_orderstatus = 'F' THEN 1L ELSE 1 + o_orderkey % 3 END AS num_replicas",
            "CASE WHEN o_orderstatus = 'F' THEN 2L ELSE 0L END AS num_stripes",
            "CASE WHEN o_orderstatus = 'F' THEN 1L ELSE 0L END AS num_recovery",
            "CASE WHEN o_orderstatus = 'F' THEN 65536L ELSE 0L END AS stripe_size",
            "o_custkey % 50 AS uid", "o_custkey % 10 AS gid",
            "CASE o_orderkey % 4 WHEN 0 THEN 420L WHEN 1 THEN 384L WHEN 2 THEN 493L ELSE 292L END AS mode",
            "o_orderkey % 4 AS min_tier", "least(15L, o_orderkey % 4 + o_orderkey % 3) AS max_tier", "mtime",
        )

    @cached_property
    def fattr(self) -> DataFrame:
        """Directories and files together; a directory's own attributes are fixed."""
        d = self.dirs.selectExpr("fid", "parent", "name", "'dir' AS type", *[f"{v}L AS {k}" for k, v in _DIR.items()])
        return d.union(self.files.select("fid", "parent", "name", F.lit("file").alias("type"), *_DIR))

    @cached_property
    def replicas(self) -> DataFrame:
        n = self.table("supplier").agg(F.count(F.lit(1)).alias("n_servers"))
        c = self.chunks.join(self.attributes.select("fid", "num_replicas").repartition(self.parts, "fid"), "fid").join(F.broadcast(n))
        r = c.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_replicas") - 1))).filter("(chunk_id + 13 * k) % 29 <> 0")
        late = "CASE WHEN (chunk_id + k) % 41 = 0 THEN 1 ELSE 0 END"
        return r.selectExpr("fid", "idx", "chunk_id", "k", "(suppkey + 37 * k) % n_servers AS server_id", f"version - {late} AS version", "size")

    @cached_property
    def places(self) -> DataFrame:
        """Servers without what they hold."""
        return self.table("supplier").selectExpr("s_suppkey AS server_id", "s_name AS host", "30000 + s_suppkey AS port", "cast(s_nationkey % 9 AS bigint) AS rack", "1000000000000L AS total")

    @cached_property
    def servers(self) -> DataFrame:
        used = self.replicas.groupBy("server_id").agg(F.sum("size").alias("used"))
        return self.places.join(used, "server_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))

    @cached_property
    def user_group(self) -> DataFrame:
        u = self.spark.range(50)
        return u.selectExpr("id AS uid", "id % 10 AS gid").union(u.selectExpr("id AS uid", "(id + 3) % 10 AS gid")).distinct()

    @cached_property
    def samples(self) -> DataFrame:
        e = self.table("events").withColumn("us", micros("ts")).withColumn("value", F.expr("cast(round(value * 100) AS bigint)"))
        total = F.sum("value").over(Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
        return e.select("event_id", "us", F.col("user_id").alias("server"), "value", total.alias("cumulative"))

    @cached_property
    def oplog(self) -> DataFrame:
        n = self.table("orders").agg(F.count(F.lit(1)).alias("n_files"))
        kind = "CASE event_type WHEN 'signup' THEN 'mkdir' WHEN 'view' THEN 'setmtime' WHEN 'click' THEN 'create' WHEN 'purchase' THEN 'truncate' ELSE 'remove' END"
        e = self.table("events").withColumn("us", micros("ts")).join(F.broadcast(n))
        return e.selectExpr("event_id AS seq", "us", "user_id AS uid", f"{kind} AS op", "1000000000L + event_id % n_files AS fid", "cast(round(value * 100) AS bigint) AS arg", "event_id % 11 <> 0 AS committed")

    @cached_property
    def documents(self) -> DataFrame:
        """Texts, which mostly go to Python: a batch of them must fit a worker, however long they are."""
        small_batches(self.spark)
        return self.table("documents")

    @cached_property
    def file_bytes(self) -> DataFrame:
        return self.documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


_DIR = {"num_replicas": 0, "num_stripes": 0, "num_recovery": 0, "stripe_size": 0, "uid": 0, "gid": 0, "mode": 493, "min_tier": 15, "max_tier": 15, "mtime": 0, "size": 0, "chunk_count": 0}

SQL_TABLES = """WITH RECURSIVE
dirs AS (SELECT 2::BIGINT AS fid, 2::BIGINT AS parent, '/' AS name
  UNION ALL SELECT 10 + r_regionkey, 2, r_name FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, n_name FROM nation
  UNION ALL SELECT 1000000 + c_custkey, 100 + c_nationkey, c_name FROM customer),
ch0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx FROM lineitem),
chunks AS (SELECT 1000000000 + l_orderkey AS fid, idx, (1000000000 + l_orderkey) * 1000 + idx AS chunk_id, idx * 67108864 AS "offset",
  1 + l_partkey % 7 AS version, round(l_extendedprice * 100)::BIGINT % 67108865 AS size, l_suppkey AS suppkey FROM ch0),
pf AS (SELECT fid, sum(size)::BIGINT AS bytes, count(*) AS n FROM chunks GROUP BY fid),
files AS (SELECT 1000000000 + o_orderkey AS fid, 1000000 + o_custkey AS parent, 'o' || o_orderkey AS name,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 1 + o_orderkey % 3 END::BIGINT AS num_replicas, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END::BIGINT AS num_stripes,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT AS num_recovery, CASE WHEN o_orderstatus = 'F' THEN 65536 ELSE 0 END::BIGINT AS stripe_size,
  o_custkey % 50 AS uid, o_custkey % 10 AS gid, CASE o_orderkey % 4 WHEN 0 THEN 420 WHEN 1 THEN 384 WHEN 2 THEN 493 ELSE 292 END::BIGINT AS mode,
  o_orderkey % 4 AS min_tier, least(15, o_orderkey % 4 + o_orderkey % 3) AS max_tier, epoch_us(o_orderdate) AS mtime,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE coalesce(bytes, 0) END::BIGINT AS size, coalesce(n, 0)::BIGINT AS chunk_count
  FROM orders LEFT JOIN pf ON pf.fid = 1000000000 + o_orderkey),
fattr AS (SELECT fid, parent, name, 'dir' AS type, 0::BIGINT AS num_replicas, 0::BIGINT AS num_stripes, 0::BIGINT AS num_recovery, 0::BIGINT AS stripe_size,
  0::BIGINT AS uid, 0::BIGINT AS gid, 493::BIGINT AS mode, 15::BIGINT AS min_tier, 15::BIGINT AS max_tier, 0::BIGINT AS mtime, 0::BIGINT AS size, 0::BIGINT AS chunk_count FROM dirs
  UNION ALL SELECT fid, parent, name, 'file', num_replicas, num_stripes, num_recovery, stripe_size, uid, gid, mode, min_tier, max_tier, mtime, size, chunk_count FROM files),
replicas AS (SELECT c.fid, idx, chunk_id, k, (suppkey + 37 * k) % (SELECT count(*) FROM supplier) AS server_id,
  version - CASE WHEN (chunk_id + k) % 41 = 0 THEN 1 ELSE 0 END AS version, c.size
  FROM (SELECT c.*, unnest(range(num_replicas)) AS k FROM chunks c JOIN files f ON c.fid = f.fid) c WHERE (chunk_id + 13 * k) % 29 <> 0),
servers AS (SELECT s_suppkey AS server_id, s_name AS host, 30000 + s_suppkey AS port, (s_nationkey % 9)::BIGINT AS rack, 1000000000000::BIGINT AS total, coalesce(u, 0)::BIGINT AS used
  FROM supplier LEFT JOIN (SELECT server_id AS sid, sum(size) AS u FROM replicas GROUP BY 1) ON sid = s_suppkey),
user_group AS (SELECT DISTINCT uid, gid FROM (SELECT u AS uid, u % 10 AS gid FROM range(50) t(u) UNION ALL SELECT u, (u + 3) % 10 FROM range(50) t(u))),
samples AS (SELECT event_id, epoch_us(ts) AS us, user_id AS server, round(value * 100)::BIGINT AS value,
  (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative FROM events),
oplog AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id AS uid,
  CASE event_type WHEN 'signup' THEN 'mkdir' WHEN 'view' THEN 'setmtime' WHEN 'click' THEN 'create' WHEN 'purchase' THEN 'truncate' ELSE 'remove' END AS op,
  1000000000 + event_id % (SELECT count(*) FROM orders) AS fid, round(value * 100)::BIGINT AS arg, event_id % 11 <> 0 AS committed FROM events),
anc AS (SELECT fid, parent AS a, 1 AS d FROM fattr WHERE fid <> 2 UNION ALL SELECT anc.fid, dirs.parent, d + 1 FROM anc JOIN dirs ON anc.a = dirs.fid WHERE anc.a <> 2),
path AS (SELECT fid, name, parent, '/' AS p FROM dirs WHERE fid = 2 UNION ALL SELECT f.fid, f.name, f.parent, CASE WHEN path.p = '/' THEN '/' || f.name ELSE path.p || '/' || f.name END
  FROM fattr f JOIN path ON f.parent = path.fid WHERE f.fid <> 2)
"""
