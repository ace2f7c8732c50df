"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lens import Lens, micros
from ..storage import shared_root
from ..streaming import log, retention
from .catalog import query

_KIND = "CASE event_type WHEN 'signup' THEN 'mkdir' WHEN 'view' THEN 'setmtime' WHEN 'click' THEN 'create' WHEN 'purchase' THEN 'truncate' ELSE 'remove' END"


def _root(spark) -> str:
    return f"{shared_root(spark)}/treeline/stream-{uuid.uuid4().hex}"


def _events(x: Lens):
    schema = x.table("events").schema
    s = x.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(x.sf_dir)
    return s.withColumn("us", micros("ts")).selectExpr("event_id AS seq", "us", "user_id AS uid", f"{_KIND} AS op")


@query("SELECT us // 3600000000 AS hour, op, count(*) AS n FROM oplog GROUP BY ALL")
def stream_ops_hourly(x: Lens):
    root = _root(x.spark)
    log.run_to_end(log.hourly(_events(x)), f"{root}/state", "complete", foreach=lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out"))
    return x.spark.read.parquet(f"{root}/out")


@query("SELECT seq, op FROM oplog o WHERE seq <= (SELECT max(seq) FROM oplog c WHERE c.seq % 100 = 0 AND c.uid % 2 = o.uid % 2)")
def stream_committed(x: Lens):
    """Two logs, by the parity of the user; each hundredth entry commits what is before it."""
    root = _root(x.spark)
    e = _events(x).withColumns({"log": F.col("uid") % 2, "fid": F.lit(0).cast("long"), "arg": F.lit(0).cast("long")})
    kinds = F.when(F.col("seq") % 100 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    queue = log.commit_queue(e.withColumn("kind", F.explode(kinds)))
    log.run_to_end(queue, f"{root}/state", foreach=log.append_sink(f"{root}/out"))
    return x.spark.read.parquet(f"{root}/out").select("seq", "op")


@query()
def retention_exact(x: Lens):
    return retention.exact(x.samples)
