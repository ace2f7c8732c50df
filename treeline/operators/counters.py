"""Counter samples: differences, rates, averages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EWMA_BITS, RETENTION
from .layout import div


def _by(*order: str):
    return Window.partitionBy("server").orderBy(*order)


def delta(samples: DataFrame, value: str = "cumulative") -> DataFrame:
    """The first difference is the value itself."""
    return samples.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(_by("us", "event_id")))


def rate(samples: DataFrame, value: str = "cumulative") -> DataFrame:
    """Change per second; 0 for the first sample, null where no time has passed."""
    w = _by("us", "event_id")
    dv, dt = F.col(value) - F.lag(value).over(w), F.col("us") - F.lag("us").over(w)
    return samples.withColumn("rate", F.when(F.lag("us").over(w).isNull(), F.lit(0.0)).otherwise((dv * 1000000).cast("double") / F.nullif(dt, F.lit(0).cast("long")).cast("double")))


def interval_delta(samples: DataFrame, interval_us: int, value: str = "cumulative") -> DataFrame:
    """Against the newest sample at least that old, else against the oldest; for counters that never fall."""
    old = F.max(value).over(_by("us").rangeBetween(Window.unboundedPreceding, -interval_us))
    first = F.min(value).over(Window.partitionBy("server"))
    return samples.withColumn("delta", F.col(value) - F.coalesce(old, first))


def sampler(samples: DataFrame, n: int, value: str = "cumulative") -> DataFrame:
    """Total of the last n samples, and (last - first) per second between them, truncated; 0 if no time has passed."""
    w = _by("us", "event_id").rowsBetween(1 - n, 0)
    seconds = div(F.col("us"), 1000000) - div(F.first("us").over(w), 1000000)
    slope = F.when(seconds > 0, div(F.col(value) - F.first(value).over(w), seconds)).otherwise(0)
    return samples.withColumns({"total": F.sum(value).over(w).cast("long"), "slope": slope.cast("long")})


def ewma(samples: DataFrame, weight: int, value: str = "value") -> DataFrame:
    """(server, n, avg): the last fixed-point moving average of each server, from 0.

    The average depends on the order of all samples of a server, so a server's
    values are one array; an hour of samples is a few hundred numbers.
    """
    rows = samples.groupBy("server").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", F.col(value).alias("v")))).alias("all"))
    step = lambda a, x: F.shiftright(a * weight + F.shiftleft(x["v"], EWMA_BITS) * (4096 - weight), EWMA_BITS)
    avg = F.aggregate("all", F.lit(0).cast("long"), step)
    return rows.select("server", F.size("all").cast("long").alias("n"), avg.alias("avg"))


def retention(samples: DataFrame, levels=RETENTION) -> DataFrame:
    """(server, level, bucket, us, value): the first sample of each of the newest buckets of each resolution."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(n).alias("slots"), F.lit(s * 1000000).cast("long").alias("span")) for i, (n, s) in enumerate(levels)]))
    rows = samples.withColumn("l", parts).select("server", "us", "event_id", "value", F.col("l.level").alias("level"), F.col("l.slots").alias("slots"), div(F.col("us"), F.col("l.span")).alias("bucket"))
    first = rows.groupBy("server", "level", "slots", "bucket").agg(F.min_by(F.struct("us", "value"), F.struct("us", "event_id")).alias("f"))
    newest = F.row_number().over(Window.partitionBy("server", "level").orderBy(F.desc("bucket")))
    return first.withColumn("r", newest).filter("r <= slots").select("server", "level", "bucket", "f.us", "f.value")


def rpc_stats(ops: DataFrame, us_per_sample: int = 86_400_000_000) -> DataFrame:
    """(sample, op, total, errors, avg_arg, per_mille): by sample and operation, with a TOTAL for each sample."""
    rows = ops.withColumn("sample", div(F.col("us"), us_per_sample))
    cube = rows.rollup("sample", "op").agg(F.count(F.lit(1)).alias("total"), F.sum((~F.col("committed")).cast("long")).alias("errors"), F.sum("arg").alias("time"), F.grouping("op").alias("g_op"), F.grouping("sample").alias("g_s"))
    cube = cube.filter("g_s = 0").withColumn("op", F.when(F.col("g_op") == 1, "TOTAL").otherwise(F.col("op")))
    whole = F.max(F.when(F.col("g_op") == 1, F.col("total"))).over(Window.partitionBy("sample"))
    return cube.select("sample", "op", "total", "errors", div(F.col("time"), F.col("total")).alias("avg_arg"), div(F.col("total") * 1000, whole).alias("per_mille"))


def table(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Differences of two snapshots (server, columns...), with a row 'total'."""
    b = before.select("server", *[F.col(c).alias(f"b_{c}") for c in columns])
    rows = after.join(b, "server").select(F.col("server").cast("string").alias("server"), *[(F.expr(f"try_cast({c} AS bigint)") - F.expr(f"try_cast(b_{c} AS bigint)")).alias(f"d_{c}") for c in columns])
    total = rows.agg(*[F.sum(f"d_{c}").cast("long").alias(f"d_{c}") for c in columns]).select(F.lit("total").alias("server"), "*")
    return rows.union(total)


def sessions(events: DataFrame, key: str, gap_us: int) -> DataFrame:
    """(key, session, first, last, n): runs of events no further apart than the gap."""
    w = Window.partitionBy(key).orderBy("us", "event_id")
    start = F.coalesce(((F.col("us") - F.lag("us").over(w)) > gap_us).cast("long"), F.lit(1).cast("long"))
    rows = events.withColumn("start", start).withColumn("session", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))


def freshness(events: DataFrame, key: str, now_us: Column, timeout_us: int) -> DataFrame:
    """(key, last, down): whether the last event is older than the timeout."""
    last = events.groupBy(key).agg(F.max("us").alias("last"))
    return last.withColumn("down", now_us - F.col("last") > timeout_us)


def of_hosts(samples: DataFrame, hosts: DataFrame) -> DataFrame:
    """(server, us, value): the last sample of each server in ``hosts`` (server)."""
    last = samples.join(hosts, "server", "left_semi").groupBy("server").agg(F.max(F.struct("us", "event_id", "value")).alias("last"))
    return last.select("server", "last.us", "last.value")
