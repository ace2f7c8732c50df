"""What queries move, from their plans and settings: no more than their rows ask for, however large the tables are."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.lens import Lens
from treeline.plans import catalog
from treeline.storage import parts_for

from .conftest import SF


@pytest.fixture
def plan(spark):
    """The plan of a query, with no table small enough for Spark to broadcast on its own."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)


def exchanges(text):
    """Keys of the hash exchanges of a plan."""
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in text.splitlines() if "Exchange hashpartitioning(" in line]


def test_partitions_follow_the_input(spark):
    assert parts_for(spark, 0) == 4 and parts_for(spark, 1 << 30) == 256


def test_nothing_is_written_by_a_lens(spark):
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("treeline_")}
    before = names()
    x = Lens(spark, SF)
    assert x.replicas.count() > x.chunks.count() > x.files.count() > 0 and names() == before


def test_locations_move_line_items_and_orders_once(plan):
    keys = exchanges(plan("chunk_locations"))
    assert len(keys) == 2 and all(k.startswith("fid#") for k in keys)


def test_targets_are_those_of_all_pairs(spark):
    """Racks that are full or unknown, servers that hold the chunk, negative ids: as if every server were looked at for every copy."""
    from treeline.operators.placement import MIX, _Targets

    rest = lambda x: abs(x) % MIX * (1 if x >= 0 else -1)
    r = random.Random(3)
    ids = r.sample(range(-50, 3_000_000), 60)
    racks = [r.choice([7, 9, None]) for _ in ids]
    chunks = sorted(r.randrange(MIX) for _ in range(300))
    stay = [r.choices([7, 9, 11], k=r.randrange(5)) for _ in chunks]
    held = [r.sample(ids, r.choice([0, 2, 20, 60])) for _ in chunks]

    def key(c, s, k):
        a = (c + s * 104729) % MIX
        b = a * a % MIX
        return 0 if k is None else stay[i].count(k), rest((b + s) * (b + 7919)), s

    want = []
    for i, c in enumerate(chunks):
        best = min((key(c, s, k) for s, k in zip(ids, racks, strict=True) if s not in held[i]), default=None)
        want.append(best and (best[2], best[0]))
    import numpy as np

    assert _Targets(ids, racks).place(np.array(chunks), stay, held) == want


def test_an_evacuation_carries_no_servers_along(plan):
    assert "offers" not in plan("evacuation_plan")


def test_a_layout_moves_one_file(plan):
    lines = plan("getlayout").splitlines()
    tables = [i for i, line in enumerate(lines) if "FileScan parquet" in line and ("lineitem" in line or "l_orderkey" in line)]
    assert tables and all("= 1000000007" in "".join(lines[i - 2 : i]) for i in tables)


def test_sizes_are_found_within_files(plan):
    keys = exchanges(plan("compute_filesize"))
    assert keys and all(k.startswith("fid#") for k in keys)


def test_last_chunk_without_a_sized_copy(spark):
    from treeline.operators.layout import effective_size

    files = spark.createDataFrame([(1, -1), (2, -1), (3, 7), (4, -1)], "fid long, size long")
    chunks = spark.createDataFrame([(1, 10, 0), (1, 11, 64 << 20), (2, 20, 0), (3, 30, 0)], "fid long, chunk_id long, offset long")
    copies = spark.createDataFrame([(1, 10, 99), (1, 11, 5), (1, 11, 6), (2, 20, 0), (3, 30, 8)], "fid long, chunk_id long, size long")
    assert sorted(map(tuple, effective_size(files, chunks, copies).collect())) == [(1, (64 << 20) + 6), (2, 64 << 20), (3, 7), (4, 0)]


def test_a_report_checks_the_store_once(plan):
    text = plan("fsck_report")
    assert text.count("Union") == 1 and all(k.startswith("fid#") for k in exchanges(text))


def test_worm_reads_no_chunks(plan):
    text = plan("worm_violations")
    assert "l_orderkey" not in text and "treeline_files" not in text and len(exchanges(text)) == 2


def test_copies_are_counted_within_files(plan):
    keys = exchanges(plan("replication_minmax"))
    assert keys and all(k.startswith("fid#") for k in keys)


def test_inventories_meet_once(plan):
    """By server and chunk, and never by server alone."""
    keys = exchanges(plan("inventory_diff"))
    assert sum("server_id" in k for k in keys) == 3 and all("chunk_id" in k for k in keys if "server_id" in k)


def test_texts_go_to_python_in_short_batches(spark):
    """Also through the scrubber, whose files are longer than their texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for name in ("scrub", "escape_round_trip", "inflate_text"):
            spark.conf.set(key, "10000")
            catalog.QUERIES[name](spark, SF)
            assert int(spark.conf.get(key)) <= 128
            spark.conf.set(key, "20")
            catalog.QUERIES[name](spark, SF)
            assert spark.conf.get(key) == "20"
    finally:
        spark.conf.set(key, before)
