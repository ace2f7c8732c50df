import pandas as pd
from pyspark.sql import functions as F

from treeline.streaming import log


def rows_of(spark, tmp_path, schema, batches):
    """A stream of one file for each batch."""
    d = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{d}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{d}")


def test_dedup_within_the_window(spark, tmp_path):
    s = 1_000_000
    stream = rows_of(spark, tmp_path, "uid long, rid long, us long", [[(1, 1, 0), (1, 2, s)], [(1, 1, 60 * s), (2, 1, 61 * s)], [(1, 3, 62 * s)]])
    out = f"file://{tmp_path}/out"
    log.run_to_end(log.dedup(stream), f"file://{tmp_path}/state", foreach=log.append_sink(out))
    assert sorted(map(tuple, spark.read.parquet(out).select("uid", "rid").collect())) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_commit_queue_waits(spark, tmp_path):
    schema = "log long, kind string, seq long, op string, fid long, arg long, us long"
    a = lambda n, seq: (n, "a", seq, "create", 1, 0, 0)
    c = lambda n, seq: (n, "c", seq, None, None, None, None)
    stream = rows_of(spark, tmp_path, schema, [[a(1, 1), a(1, 2), a(2, 9)], [c(1, 1), a(1, 3)], [c(1, 3)]])
    out = f"file://{tmp_path}/out"
    log.run_to_end(log.commit_queue(stream), f"file://{tmp_path}/state", foreach=log.append_sink(out))
    got = spark.read.parquet(out).select("log", "seq", "batch").collect()
    assert sorted((r.log, r.seq) for r in got) == [(1, 1), (1, 2), (1, 3)]


def test_a_batch_that_comes_again_is_there_once(spark, tmp_path):
    sink = log.append_sink(f"file://{tmp_path}/out")
    df = spark.createDataFrame(pd.DataFrame({"x": [1, 2, 3]}))
    sink(df, 0)
    sink(df, 0)
    sink(df, 1)
    assert spark.read.parquet(f"file://{tmp_path}/out").agg(F.count("*")).first()[0] == 6


def test_commit_queue_holds_no_log_in_a_worker(spark, tmp_path):
    """Entries of two logs over four batches, some waiting for more than one, in order and each once; no Python runs."""
    schema = "log long, kind string, seq long, op string, fid long, arg long, us long"
    a = lambda n, seq: (n, "a", seq, f"o{seq}", 1, 0, 0)
    c = lambda n, seq: (n, "c", seq, None, None, None, None)
    stream = rows_of(spark, tmp_path, schema, [[a(1, 3), a(1, 1), a(2, 5)], [a(1, 2), a(2, 4)], [c(1, 2), c(1, 1)], [c(2, 9), a(1, 4), a(2, 8)]])
    got, plans = [], []

    def sink(df, batch):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        got.append([(r.log, r.seq, r.op) for r in df.collect()])

    log.run_to_end(log.commit_queue(stream), f"file://{tmp_path}/state", foreach=sink)
    assert got == [[], [], [(1, 1, "o1"), (1, 2, "o2")], [(2, 4, "o4"), (2, 5, "o5"), (2, 8, "o8")]]
    assert plans and not any("Python" in p or "InPandas" in p for p in plans)
    left = spark.read.parquet(f"file://{tmp_path}/state/queue/waiting-3")
    assert sorted(r.seq for r in left.collect()) == [3, 4]
    assert not (tmp_path / "state/queue/waiting-1").exists()
