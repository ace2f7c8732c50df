"""Counters of servers as CSV text: a row of names, then a row for each server; reads as one row for each counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(counters: DataFrame, path: str) -> None:
    counters.write.option("header", True).csv(path)


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, counter, value) of every column but ``key``."""
    return long_form(spark.read.option("header", True).option("enforceSchema", False).csv(path), key)


def long_form(wide: DataFrame, key: str) -> DataFrame:
    """A row for each counter; spaces around names and values are no part of them, and text that is no number is null."""
    names = [c for c in wide.columns if c.strip() != key]
    source = next(c for c in wide.columns if c.strip() == key)
    pairs = F.array(*[F.struct(F.lit(c.strip()).alias("counter"), F.trim(F.col(f"`{c}`").cast("string")).try_cast("long").alias("value")) for c in names])
    return wide.select(F.trim(F.col(f"`{source}`").cast("string")).alias(key), F.explode(pairs).alias("x")).select(key, "x.counter", "x.value")
