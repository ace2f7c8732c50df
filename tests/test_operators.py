import errno

import pytest
from pyspark.sql import functions as F

from treeline.api import Namespace
from treeline.lens import Lens
from treeline.operators import namespace, oplog, placement
from treeline.sources import audit_text, checkpoint_text, chunkmap, counters_csv, log_text

from .conftest import SF


@pytest.fixture(scope="module")
def lens(spark):
    return Lens(spark, SF)


def test_fixture_is_sound(lens):
    f = lens.fattr
    assert f.count() == f.select("fid").distinct().count()
    assert f.join(lens.dirs.select(F.col("fid").alias("p")), F.col("parent") == F.col("p"), "left_anti").count() == 0
    assert lens.chunks.count() == lens.chunks.select("chunk_id").distinct().count()


def test_rollup_of_the_root_is_the_whole(lens):
    r = namespace.rollup(lens.fattr, lens.dirs).filter("fid = 2").first()
    total = lens.files.agg(F.sum("size"), F.count("*")).first()
    assert (r.bytes, r.files, r.dirs) == (total[0], total[1], lens.dirs.count() - 1)


def test_depth_is_found(lens):
    assert sorted(map(tuple, namespace.paths(lens.dirs).collect())) == sorted(map(tuple, namespace.paths(lens.dirs, lens.DEPTH).collect()))


def test_rebalance_invariants(lens):
    plan = placement.plan_round(lens.replicas, lens.places, 200)
    moves = plan.collect()
    assert moves and len({m.chunk_id for m in moves}) == len(moves)
    after = placement.apply_plan(lens.replicas, plan)
    assert after.count() == lens.replicas.count()
    twice = lambda r: r.groupBy("chunk_id", "server_id").count().filter("count > 1").count()
    assert twice(after) <= twice(lens.replicas)
    racks = lens.servers.select("server_id", "rack")
    crowd = lambda r: r.join(racks, "server_id").groupBy("chunk_id", "rack").count().filter("count > 1").count()
    assert crowd(after) <= crowd(lens.replicas)
    before = {r.server_id: r.side for r in placement.thresholds(placement.usage(lens.replicas, lens.places), 200).collect()}
    assert all(before[m.from_server] == "over" and before[m.to_server] == "under" for m in moves)


def test_checkpoint_round_trip(lens, spark, tmp_path):
    p = f"file://{tmp_path}/cp"
    checkpoint_text.write(lens.fattr, lens.chunks, p, 7)
    assert [r.ok for r in checkpoint_text.verify(spark, p).collect()] == [True]
    dentry, fattr, chunks = checkpoint_text.read(spark, p)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(dentry, "fid", "parent", "name") == key(lens.fattr, "fid", "parent", "name")
    cols = ("fid", "type", "chunk_count", "num_replicas", "size", "num_stripes", "num_recovery", "stripe_size", "uid", "gid", "mode", "mtime", "min_tier")
    assert key(fattr, *cols) == key(lens.fattr, *cols)
    assert key(chunks, "fid", "chunk_id", "offset", "version") == key(lens.chunks, "fid", "chunk_id", "offset", "version")


def test_broken_checkpoint_is_found(lens, spark, tmp_path):
    p = tmp_path / "cp"
    checkpoint_text.write(lens.fattr, lens.chunks, f"file://{p}", 7)
    part = next(p.glob("part-*"))
    part.write_text(part.read_text().replace("worm/0", "worm/1"))
    (p / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r.ok for r in checkpoint_text.verify(spark, f"file://{p}").collect()] == [False]


def test_log_text(lens, spark, tmp_path):
    p = f"file://{tmp_path}/log"
    ops = lens.oplog.filter("seq < 50").select("seq", "op", "fid", "arg", "us")
    log_text.write(ops, spark.createDataFrame([(20,), (30,)], "seq long"), p)
    assert sorted(r.seq for r in log_text.read(spark, p).collect()) == list(range(31))
    spark.createDataFrame([("z/1",)], "value string").write.mode("append").text(p)
    with pytest.raises(Exception, match="not a log entry"):
        log_text.read(spark, p).collect()


def test_chunk_map_round_trip(lens, spark, tmp_path):
    s = lens.servers.select("server_id", "host", "port", "rack")
    p = f"file://{tmp_path}/map"
    chunkmap.write_chunk_map(chunkmap.dump(lens.chunks, lens.replicas, s), p)
    back = chunkmap.read_chunk_map(spark, p).filter("host IS NOT NULL")
    want = lens.replicas.join(s, "server_id").select("chunk_id", "fid", "host", "port", "rack")
    assert sorted(map(tuple, back.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_repeated_requests_do_not_renew_the_window(spark):
    minute = 60_000_000
    rows = [(i, "create", 1, 7, 5 * i * minute) for i in range(12)] + [(20, "remove", 1, 7, minute), (21, "create", 1, -1, 0), (22, "create", 1, -1, 1), (23, "create", None, 7, 0), (24, "create", None, 7, 1)]
    out = oplog.dedup_requests(spark.createDataFrame(rows, "seq long, op string, uid long, rid long, us long"), 6 * minute)
    assert sorted(r.seq for r in out.collect()) == [0, 2, 4, 6, 8, 10, 20, 21, 22, 23, 24]


def test_fold(spark):
    rows = [(1, "create", 1, 0, 10), (2, "truncate", 1, 7, 20), (3, "remove", 2, 0, 30), (4, "create", 2, 0, 40), (5, "setmtime", 1, 0, 50), (6, "remove", 1, 0, 60), (7, "create", 1, 0, 70), (8, "truncate", 3, 5, 80)]
    out = oplog.fold(spark.createDataFrame(rows, "seq long, op string, fid long, arg long, us long"))
    assert sorted(map(tuple, out.collect())) == [(1, True, 0, 70, 5), (2, True, 0, 40, 2), (3, True, 5, 0, 1)]


def test_namespace(lens):
    ns = Namespace.of(lens)
    assert ns.exists("/") and ns.is_dir("/ASIA") and not ns.exists("/NOWHERE/x")
    nation = ns.readdir("/ASIA").first().name
    customers = ns.readdir(f"/ASIA/{nation}").collect()
    assert [c.name for c in customers] == sorted(c.name for c in customers)
    assert ns.dus("/").first().bytes == lens.files.agg(F.sum("size")).first()[0]
    assert sum(r.bytes for r in ns.du("/").collect()) == ns.dus("/").first().bytes
    assert ns.glob("/AS*").select("path").collect()[0].path == "/ASIA"


def test_verbs(lens):
    """The verbs of the command line on a small tree, with what they refuse."""
    small = lens.spark.createDataFrame(lens.fattr.filter("fid = 2").collect(), lens.fattr.schema).coalesce(1)
    ns = Namespace(small, lens.chunks, lens.replicas).mkdirs("/new/a/b").create("/new/a/f", us=5).symlink("/new/l")
    names = lambda n, p: [r.name for r in n.readdir(p).collect()]
    assert names(ns, "/new") == ["a", "l"] and names(ns, "/new/a") == ["b", "f"]
    for bad, code in [
        (lambda: ns.mkdir("/new/a"), "EEXIST"), (lambda: ns.create("/none/f"), "ENOENT"), (lambda: ns.create("/new/a/f/x"), "ENOTDIR"), (lambda: ns.remove("/new/a"), "EISDIR"),
        (lambda: ns.rmdir("/new/a"), "ENOTEMPTY"), (lambda: ns.rmdir("/new/l"), "ENOTDIR"), (lambda: ns.rename("/new/a", "/new/a/b/c"), "EINVAL"), (lambda: ns.rename("/new/l", "/new/a/f", overwrite=False), "EEXIST"), (lambda: ns.mkdir("/new/.."), "EINVAL"),
    ]:
        with pytest.raises(OSError) as e:
            bad()
        assert errno.errorcode[e.value.errno] == code
    ns = ns.rename("/new/l", "/new/a/f").rmdir("/new/a/b").rename("/new/a", "/new/z").truncate("/new/z/f", 9)
    assert names(ns, "/new") == ["z"] and ns.lookup("/new/z/f").select("type", "size").first() == ("link", 9)
    assert ns.remove("/new/z/f").rmdir("/new/z").readdir("/new").count() == 0


def test_tiers_and_what_is_below(lens):
    ns = Namespace.of(lens)
    n = ns.below("/ASIA").filter("type = 'file'").count()
    assert n == ns.count("/ASIA").first().files and ns.below("/ASIA").count() == n + ns.count("/ASIA").first().dirs
    assert ns.set_tiers("/ASIA", 3, 4).fattr.filter("min_tier = 3 AND max_tier = 4").count() >= n


def test_rebalance_ends(lens):
    """Rounds go on until there is no move; no copy is lost and none is doubled, and use comes closer to the mean."""
    spread = lambda r: placement.usage(r, lens.places).agg(F.stddev("util")).first()[0]
    after, moved = placement.rebalance(lens.replicas, lens.places, 200, rounds=2, cut=lambda df: df.cache())
    assert moved and after.count() == lens.replicas.count()
    assert spread(after) < spread(lens.replicas)
    racks = lens.places.select("server_id", "rack")
    wanted = lens.chunks.select("chunk_id").limit(50)
    new = placement.new_copies(wanted, lens.replicas, lens.places)
    clash = lens.replicas.join(racks, "server_id").select("chunk_id", "rack")
    assert new.count() > 0 and new.join(racks, F.col("to_server") == F.col("server_id")).join(clash, ["chunk_id", "rack"]).count() == 0


def test_evacuation_ends(lens):
    """Rounds empty the servers that leave; no copy is lost, none meets another of its chunk."""
    leaving = lens.places.filter("server_id % 7 = 3")
    held, rounds = lens.replicas, 0
    while True:
        plan = placement.evacuate(lens.files, held, lens.places, leaving).cache()
        if plan.count() == 0:
            break
        assert plan.join(leaving, plan.to_server == leaving.server_id).count() == 0
        held, rounds = placement.apply_plan(held, plan).cache(), rounds + 1
    assert 1 <= rounds <= 8
    assert held.join(leaving, "server_id", "left_semi").count() == 0 and held.count() == lens.replicas.count()
    twice = lambda r: r.groupBy("chunk_id", "server_id").count().filter("count > 1").count()
    assert twice(held) <= twice(lens.replicas)


def test_evacuation_of_small_stores(spark):
    """A block of a striped file goes to the rack with the fewest of its chunks; with every rack in use, to the least used."""
    files = spark.createDataFrame([(1, 2, 1, 1), (2, 0, 0, 2)], "fid long, num_stripes long, num_recovery long, num_replicas long")
    servers = spark.createDataFrame([(0, 0, 1000), (1, 0, 1000), (2, 1, 1000), (3, 1, 1000), (4, 1, 1000), (5, None, 1000)], "server_id long, rack long, total long")
    rows = [(1, 0, 10, 0, 0), (1, 1, 11, 0, 2), (1, 2, 12, 0, 3), (1, 3, 13, 0, 0), (2, 0, 20, 0, 0), (2, 0, 20, 1, 2)]
    held = spark.createDataFrame(rows, "fid long, idx long, chunk_id long, k long, server_id long").withColumn("size", F.lit(1).cast("long"))
    leaving = spark.createDataFrame([(0,), (5,), (77,), (0,)], "server_id long")
    got = {r.chunk_id: (r.from_server, r.to_server, r.beside) for r in placement.evacuate(files, held, servers, leaving).collect()}
    assert got[10] == (0, 1, 0) and got[20] == (0, 1, 0)
    assert got[13][0] == 0 and got[13][1] in (1, 2, 3, 4) and set(got) == {10, 13, 20}
    full = placement.evacuate(files, held, servers.filter("rack = 1 OR server_id = 0"), leaving).collect()
    assert {r.chunk_id: r.beside for r in full} == {10: 2, 13: 0, 20: 1}
    assert all(r.to_server != 2 for r in full if r.chunk_id == 20)
    assert placement.evacuate(files, held, servers, leaving.filter("server_id = 99")).count() == 0
    assert placement.evacuate(files, held, servers.filter("server_id = 0"), leaving).count() == 0
    assert [tuple(r) for r in placement.crowded_racks(files, held, servers).collect()] == [(1, 0, 1, 2)]


def test_waiting_for_servers(spark):
    servers = spark.range(4).withColumnRenamed("id", "server_id")
    down = spark.createDataFrame([(1, 100), (2, 40), (3, 50), (2, 90)], "server_id long, since long")
    assert sorted(r[0] for r in placement.counted(servers, down, 150, 100).collect()) == [0, 1]


def test_audit_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("LOOKUP", "a: b", 5, 0), ("REMOVE", None, None, -2)], "op string, h string, uid long, status long")
    rows = rows.select(audit_text.record(F.col("op"), [("Path", F.col("h")), ("Status", F.lit("9"))], F.lit("10.0.0.1"), F.col("uid"), F.col("status")).alias("value"))
    audit_text.write(rows, str(tmp_path / "audit"))
    got = sorted(tuple(r)[:4] for r in audit_text.read(spark, str(tmp_path / "audit")).collect())
    assert got == [("LOOKUP", "10.0.0.1", 5, 0), ("REMOVE", "10.0.0.1", None, -2)]
    odd = spark.createDataFrame([("",), (None,), ("X",), ("Y\r\nStatus: ten\r\nno header",)], "value string")
    assert sorted((r.op, r.status, len(r.headers)) for r in audit_text.parse(odd).collect()) == [("X", None, 0), ("Y", None, 1)]


def test_counters_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 5, " 7 "), ("s2", None, "x")], "`server` string, `Reads` long, ` Writes` string")
    counters_csv.write(rows, str(tmp_path / "csv"))
    got = {(r.server, r.counter): r.value for r in counters_csv.read(spark, str(tmp_path / "csv"), "server").collect()}
    assert got == {("s1", "Reads"): 5, ("s1", "Writes"): 7, ("s2", "Reads"): None, ("s2", "Writes"): None}


def test_copy(lens):
    """Copies keep the shape, the sizes and the chunks; their ids are new, and what cannot be copied is refused."""
    schema = lens.fattr.schema
    tree = [(2, 2, "/", "dir", 0), (5, 2, "a", "dir", 0), (6, 5, "b", "dir", 0), (7, 6, "f", "file", 9), (8, 2, "g", "file", 1)]
    rows = [tuple(dict(zip(("fid", "parent", "name", "type", "size"), t)).get(c, 0) for c in schema.names) for t in tree]
    chunks = lens.spark.createDataFrame([(7, 0, 70, 0, 1, 9, 0), (8, 0, 80, 0, 1, 1, 0)], "fid long, idx long, chunk_id long, offset long, version long, size long, suppkey long")
    ns = Namespace(lens.spark.createDataFrame(rows, schema).coalesce(1), chunks, lens.replicas.limit(0))
    after = ns.copy("/a", "/c")
    assert sorted(r.path for r in after.paths().collect()) == ["/", "/a", "/a/b", "/a/b/f", "/c", "/c/b", "/c/b/f", "/g"]
    copied = after.lookup("/c/b/f").first()
    assert copied.size == 9 and copied.fid not in range(9)
    assert [(r.chunk_id > 80, r.size) for r in after.chunks.filter(F.col("fid") == copied.fid).collect()] == [(True, 9)]
    assert after.chunks.count() == 3 and after.fattr.select("fid").distinct().count() == 8
    assert ns.copy("/g", "/a").is_file("/a/g")
    for path, to, code in [("/a", "/g", "EEXIST"), ("/a", "/a/b", "EINVAL"), ("/none", "/c", "ENOENT"), ("/a", "/none/c", "ENOENT")]:
        with pytest.raises(OSError) as e:
            ns.copy(path, to)
        assert errno.errorcode[e.value.errno] == code
