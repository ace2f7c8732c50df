"""Server loads, placement candidates and rebalance plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PLACEMENT_LIMIT
from ..storage import small

MIX = 1000003


def usage(replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """(server_id, rack, chunks, used, total, util): util in millionths."""
    held = replicas.groupBy("server_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))
    rows = servers.select("server_id", "rack", "total").join(held, "server_id", "left")
    used = F.coalesce("bytes", F.lit(0)).cast("long")
    return rows.select("server_id", "rack", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), used.alias("used"), "total", F.call_function("div", used * 1000000, F.col("total")).alias("util"))


def thresholds(use: DataFrame, variation: int) -> DataFrame:
    """(server_id, util, low, high, side): outside of the mean plus or minus half the variation, all in millionths."""
    mean = use.agg(F.call_function("div", F.sum("util"), F.count(F.lit(1))).alias("mean"))
    rows = use.crossJoin(F.broadcast(mean))  # one row, not a pairing
    low, high = F.greatest(F.lit(0).cast("long"), F.col("mean") - variation // 2), F.least(F.lit(1000000).cast("long"), F.col("mean") + variation // 2)
    side = F.when(F.col("util") > high, "over").when(F.col("util") < low, "under").otherwise("within")
    return rows.select("server_id", "util", low.alias("low"), high.alias("high"), side.alias("side"))


def candidates(use: DataFrame, limit: float = PLACEMENT_LIMIT) -> DataFrame:
    """Servers that may take more, in the order of their load."""
    return use.filter(F.col("util") <= int(limit * 1000000)).orderBy("util", "server_id")


def weighted_order(rows: DataFrame, weight: str, seed: int = 0) -> DataFrame:
    """Random order without replacement: rows of greater weight tend to come first."""
    return rows.orderBy(-F.log(F.rand(seed)) / F.col(weight))


def plan_round(replicas: DataFrame, servers: DataFrame, variation: int) -> DataFrame:
    """(chunk_id, from_server, to_server) of one round.

    Each server over the mean gives its largest copies until it would fall below;
    each server under it takes until it would rise above.  Givers' and takers'
    bytes are laid end to end on one line, and a copy moves to the taker below it.
    A copy does not move to a server, or another rack's place, that already has its
    chunk.
    """
    use = usage(replicas, servers)
    level = thresholds(use, variation).select("server_id", "side", "low", "high")
    use = use.join(level, "server_id").withColumns({"mean": F.expr("total div 1000000 * ((low + high) div 2)")})
    give = use.filter("side = 'over'").select("server_id", (F.col("used") - F.col("mean")).alias("surplus"))
    line = Window.partitionBy("server_id").orderBy(F.desc("size"), "chunk_id", "k").rowsBetween(Window.unboundedPreceding, 0)
    moving = replicas.join(give, "server_id").withColumn("upto", F.sum("size").over(line)).filter("upto <= surplus")
    # A few rows for each server; the running sums go over servers, not over copies.
    by_server = moving.groupBy("server_id").agg(F.sum("size").alias("out"))
    before = Window.orderBy("server_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_server.withColumn("start", F.coalesce(F.sum("out").over(before), F.lit(0)))
    take = use.filter("side = 'under'").select(F.col("server_id").alias("to_server"), F.col("rack").alias("to_rack"), (F.col("mean") - F.col("used")).alias("room"))
    ends = Window.orderBy(F.desc("room"), "to_server").rowsBetween(Window.unboundedPreceding, 0)
    slots = take.withColumn("hi", F.sum("room").over(ends)).withColumn("lo", F.col("hi") - F.col("room"))
    placed = moving.join(F.broadcast(starts.select("server_id", "start")), "server_id").withColumn("at", F.col("start") + F.col("upto") - F.col("size"))
    rows = placed.join(F.broadcast(slots), (F.col("at") >= F.col("lo")) & (F.col("at") + F.col("size") <= F.col("hi")))
    racks = servers.select(F.col("server_id").alias("s2"), F.col("rack").alias("r2"))
    held = replicas.select(F.col("chunk_id").alias("c2"), F.col("server_id").alias("s2"), F.col("k").alias("k2")).join(F.broadcast(racks), "s2")
    clash = (F.col("chunk_id") == F.col("c2")) & (F.col("k") != F.col("k2")) & ((F.col("to_server") == F.col("s2")) | (F.col("to_rack") == F.col("r2")))
    ok = rows.join(held, clash, "left_anti")
    one = F.row_number().over(Window.partitionBy("chunk_id").orderBy("k"))
    return ok.withColumn("one", one).filter("one = 1").select("chunk_id", F.col("server_id").alias("from_server"), "to_server")


def apply_plan(replicas: DataFrame, plan: DataFrame) -> DataFrame:
    """``replicas`` after the moves."""
    moves = plan.select("chunk_id", F.col("from_server").alias("server_id"), "to_server")
    rows = replicas.join(moves, ["chunk_id", "server_id"], "left")
    return rows.withColumn("server_id", F.coalesce("to_server", "server_id")).drop("to_server").select(replicas.columns)


def rebalance(replicas: DataFrame, servers: DataFrame, variation: int, rounds: int = 20, cut=lambda df: df.checkpoint()) -> tuple[DataFrame, list[int]]:
    """``replicas`` after rounds of moves until one has none, and the moves of each round.

    ``cut`` ends a round's lineage.  ``rounds`` bounds the work of a call, as the last moves may go back and forth; call again to go on.
    """
    moved = []
    for _ in range(rounds):
        plan = cut(plan_round(replicas, servers, variation))
        n = plan.count()
        if n == 0:
            break
        moved.append(n)
        replicas = cut(apply_plan(replicas, plan))
    return replicas, moved


def new_copies(wanted: DataFrame, replicas: DataFrame, servers: DataFrame, limit: float = PLACEMENT_LIMIT) -> DataFrame:
    """(chunk_id, to_server) for chunks (chunk_id) that want one more copy: the least used server of a rack without the chunk.

    Racks that hold the chunk are left out, and servers over ``limit``.  A rack offers its least used server, so a
    chunk meets as many rows as there are racks, not servers; chunks with no rack left are not in the result.
    """
    best = F.min(F.struct("util", "server_id"))
    offers = usage(replicas, servers).filter(F.col("util") <= int(limit * 1000000)).groupBy("rack").agg(best.alias("x")).select("rack", "x.util", F.col("x.server_id").alias("to_server"))
    offers = offers.agg(F.collect_list(F.struct("util", "to_server", "rack")).alias("offers"))  # one row, of the racks
    holds = replicas.join(servers.select("server_id", "rack"), "server_id").groupBy("chunk_id").agg(F.collect_set("rack").alias("racks"))
    rows = wanted.select("chunk_id").join(holds, "chunk_id", "left").join(F.broadcast(offers))
    free = F.filter("offers", lambda o: ~F.coalesce(F.array_contains("racks", o["rack"]), F.lit(False)))
    return rows.select("chunk_id", F.array_min(free)["to_server"].alias("to_server")).filter("to_server IS NOT NULL")


def short_of_copies(chunks: DataFrame, files: DataFrame, replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """(fid, chunk_id, have, want, state) of chunks with fewer copies on ``servers`` (those up) than their file asks for.

    With a copy left a chunk waits for replication; with none, for recovery from its stripe, or else for a server to come back.
    """
    live = replicas.join(servers.select("server_id"), "server_id", "left_semi").groupBy("fid", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    rows = chunks.select("fid", "chunk_id").join(files.select("fid", "num_replicas", "num_stripes"), "fid").join(live, ["fid", "chunk_id"], "left")
    have = F.coalesce("n", F.lit(0)).cast("long")
    state = F.when(have > 0, "replication").when(F.col("num_stripes") > 0, "recovery").otherwise("pending")
    return rows.filter(have < F.col("num_replicas")).select("fid", "chunk_id", have.alias("have"), F.col("num_replicas").alias("want"), state.alias("state"))


def plan_counters(plan: DataFrame, replicas: DataFrame) -> DataFrame:
    """(server_id, sent, sent_bytes, got, got_bytes) of the servers in a plan."""
    held = replicas.select("chunk_id", F.col("server_id").alias("from_server"), "size")
    moves = plan.join(held, ["chunk_id", "from_server"])
    ends = F.array(F.struct(F.col("from_server").alias("server_id"), F.lit(1).alias("out")), F.struct(F.col("to_server").alias("server_id"), F.lit(0).alias("out")))
    rows = moves.select("size", F.explode(ends).alias("end")).select("size", "end.server_id", (F.col("end.out") == 1).alias("out"))
    n, size = (lambda c: F.count_if(c)), (lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0).cast("long")))
    return rows.groupBy("server_id").agg(n(F.col("out")).alias("sent"), size(F.col("out")).alias("sent_bytes"), n(~F.col("out")).alias("got"), size(~F.col("out")).alias("got_bytes"))


def grouped(files: DataFrame, replicas: DataFrame) -> DataFrame:
    """``replicas`` with ``grp``: what should lie on different racks, namely the copies of a chunk (its index), or
    the chunks of one block (its number) of a striped file that has a single copy of each."""
    kinds = files.select("fid", "num_stripes", "num_recovery", "num_replicas")
    striped = (F.col("num_stripes") > 0) & (F.col("num_replicas") == 1)
    block = F.call_function("div", F.col("idx"), F.col("num_stripes") + F.col("num_recovery"))
    return replicas.join(kinds, "fid").withColumn("grp", F.when(striped, block).otherwise(F.col("idx"))).drop(*kinds.columns[1:])


def crowded_racks(files: DataFrame, replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """(fid, grp, rack, copies) where a rack holds more than one of a group (``grouped``)."""
    rows = grouped(files, replicas).join(servers.select("server_id", "rack"), "server_id")
    return rows.groupBy("fid", "grp", "rack").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


class _Targets:
    """The servers that may take a copy, by rack, and the best of them for chunks.

    Servers are in the order of their racks and numbered in the order of their ids.  For a chunk each has a key,
    its mix times the number of servers plus its own number, so the least key is the least mix, ties by id.
    """

    #: Keys that are computed at once.
    BLOCK = 1 << 16

    def __init__(self, ids: list[int], racks: list):
        # A rack that is not known is beside no copy.
        self.codes = {r: i for i, r in enumerate(sorted({r for r in racks if r is not None}))}
        code = np.array([self.codes.get(r, len(self.codes)) for r in racks], np.int64)
        ids_ = np.array(ids, np.int64)
        order = np.lexsort((ids_, code))
        self.ids, self.code = ids_[order], code[order]
        self.by_number = np.sort(self.ids)
        self.number = np.searchsorted(self.by_number, self.ids).astype(float)
        self.used, self.starts = np.unique(self.code, return_index=True)
        self.step = (self.ids % MIX * 104729 % MIX).astype(float)
        self.low = (self.ids % MIX).astype(float)

    def keys(self, chunks: np.ndarray) -> np.ndarray:
        """A row for each chunk (below ``MIX``), a column for each server; whole numbers below 2 ** 53, so floats are exact."""
        a = chunks[:, None] + self.step
        a -= (a >= MIX) * float(MIX)
        a *= a
        a -= np.floor(a / MIX) * MIX
        mix = a + self.low
        a += 7919
        mix *= a
        mix -= np.floor(mix / MIX) * MIX
        negative = (self.ids < 0) & (mix > 0)  # a remainder has the sign of what is divided
        if negative.any():
            mix -= (negative & (np.remainder(a - 7919, MIX) + self.ids < 0)) * float(MIX)
        mix *= len(self.ids)
        mix += self.number
        return mix

    def id_of(self, key: np.ndarray) -> np.ndarray:
        return self.by_number[np.remainder(key, len(self.ids)).astype(np.int64)]

    def place(self, chunks: np.ndarray, stay: list[list], held: list[list[int]]) -> list[tuple[int, int] | None]:
        """(server, beside) for copies of ``chunks``, which are in order: ``stay``, the racks of their group's copies that stay, ``held``, the servers with the chunk."""
        out: list[tuple[int, int] | None] = []
        each, first = np.unique(chunks, return_index=True)
        ends = [*first[1:], len(chunks)]
        rows = max(1, self.BLOCK // len(self.ids))
        for at in range(0, len(each), rows):
            keys = self.keys(each[at : at + rows].astype(float))
            best = np.minimum.reduceat(keys, self.starts, axis=1)
            for j in range(len(keys)):
                for i in range(first[at + j], ends[at + j]):
                    out.append(self._one(keys[j], best[j], stay[i], held[i]))
        return out

    def _one(self, keys, best, stay, held):
        beside: dict[int, int] = {}
        for r in stay:
            if r in self.codes:
                beside[self.codes[r]] = beside.get(self.codes[r], 0) + 1
        n = np.zeros(len(self.used), np.int64)
        for c, k in beside.items():
            n[self.used == c] = k
        least = n.min()
        x = np.where(n == least, best, np.inf).argmin()
        to = int(self.id_of(best[x]))
        if to in held:  # by chance, or where every rack is full of copies: all servers are gone through
            per = np.zeros(len(self.codes) + 1, np.int64)
            per[self.used] = n
            free = ~np.isin(self.ids, np.array(held, np.int64))
            if not free.any():
                return None
            per = per[self.code]
            least = per[free].min()
            to = int(self.id_of(np.where(free & (per == least), keys, np.inf).min()))
        return to, int(least)


def evacuate(files: DataFrame, replicas: DataFrame, servers: DataFrame, leaving: DataFrame, limit: float = PLACEMENT_LIMIT, parts: int | None = None) -> DataFrame:
    """(fid, chunk_id, from_server, to_server, beside) of one round: a copy of each group on servers (server_id) that are leaving.

    The target is a server that stays, is not over ``limit`` and does not hold the chunk, on the rack with the
    fewest copies of the group that stay (``beside``); among those a mix of chunk and server decides, so a rack
    is chosen in proportion to its servers and no server is everyone's first choice.  Groups with a second
    leaving copy, or without a target, wait for the next round (``apply_plan`` in between).

    The mix knows a chunk by its remainder below ``MIX`` alone.  Copies are dealt (to ``parts`` tasks) and ordered by
    that, and the servers' mixes are computed once for each remainder, so never for more than ``MIX`` of them; a copy
    then looks at the best server of each rack.  A group has at most as many copies as a block has chunks.  The ids and
    racks of the servers that may take copies are brought to the driver and go to each worker.
    """
    gone = leaving.select("server_id", F.lit(True).alias("leaves")).distinct()
    known = servers.select("server_id", "rack").join(gone, "server_id", "left").withColumn("leaves", F.coalesce("leaves", F.lit(False)))
    able = usage(replicas, servers).filter(F.col("util") <= int(limit * 1000000)).join(gone, "server_id", "left_anti").select("server_id", "rack").toArrow()
    rows = grouped(files, replicas).join(small(known), "server_id")
    copies = rows.groupBy("fid", "grp").agg(F.collect_list(F.struct("chunk_id", "k", "server_id", "rack", "leaves")).alias("copies"))
    first = F.array_min(F.filter("copies", lambda c: c["leaves"])).alias("out")
    moving = copies.filter(F.exists("copies", lambda c: c["leaves"])).select("fid", first, "copies")
    held = F.transform(F.filter("copies", lambda c: c["chunk_id"] == F.col("out")["chunk_id"]), lambda c: c["server_id"])
    stay = F.transform(F.filter("copies", lambda c: ~c["leaves"] & c["rack"].isNotNull()), lambda c: c["rack"])
    moving = moving.select("fid", "out.chunk_id", F.col("out.server_id").alias("from_server"), F.pmod("out.chunk_id", F.lit(MIX)).alias("mixed"), stay.alias("stay"), held.alias("held"))
    moving = (moving.repartition(parts, "mixed") if parts else moving.repartition("mixed")).sortWithinPartitions("mixed")
    schema = "fid long, chunk_id long, from_server long, to_server long, beside long"
    if able.num_rows == 0:
        return moving.sparkSession.createDataFrame([], schema)
    targets = _Targets(able["server_id"].to_pylist(), able["rack"].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            found = targets.place(b["mixed"].to_numpy(zero_copy_only=False), b["stay"].to_pylist(), b["held"].to_pylist())
            keep = pa.array([f is not None for f in found])
            to, beside = (pa.array([f and f[i] for f in found], pa.int64()) for i in (0, 1))
            yield pa.record_batch([b["fid"], b["chunk_id"], b["from_server"], to, beside], ["fid", "chunk_id", "from_server", "to_server", "beside"]).filter(keep)

    return moving.mapInArrow(run, schema)


def counted(servers: DataFrame, down: DataFrame, now: int, window: int) -> DataFrame:
    """``servers`` whose copies count: those not in ``down`` (server_id, since), and those down for less than ``window``
    microseconds, as a server that hibernates is waited for before its chunks are copied anew."""
    late = down.filter(F.col("since") + window <= now)
    return servers.join(late.select("server_id"), "server_id", "left_anti")
