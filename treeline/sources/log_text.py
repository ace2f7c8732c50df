"""Text of log segments: ``a/seq/op/fid/arg/us`` written ahead, ``c/seq`` for a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import committed


def write(ops: DataFrame, commits: DataFrame, path: str) -> None:
    ahead = ops.select(F.concat_ws("/", F.lit("a"), "seq", "op", "fid", "arg", "us").alias("value"))
    ahead.union(commits.select(F.concat_ws("/", F.lit("c"), "seq").alias("value"))).write.text(path)


def parse(lines: DataFrame) -> DataFrame:
    """(kind, seq, op, fid, arg, us) of (value); works on a stream too.  A line of any other form is an error."""
    p = F.split("value", "/")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    good = F.col("value").rlike(r"^(a/\d+/\w+/-?\d+/-?\d+/-?\d+|c/\d+)$")
    kind = F.when(good, F.get(p, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not a log entry: "), "value")))
    return lines.select(kind.alias("kind"), n(1).alias("seq"), F.get(p, F.lit(2)).alias("op"), n(3).alias("fid"), n(4).alias("arg"), n(5).alias("us"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Operations up to the last commit."""
    rows = parse(spark.read.text(path))
    return committed(rows.filter("kind = 'a'").drop("kind"), rows.filter("kind = 'c'").select("seq"))
