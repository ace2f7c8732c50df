"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its word shingles.  Documents of equal sets are one
class, and only its representative goes on.  Its signature is a row of b-bit
minhashes, cut into chunks as the ``Scheme`` of the percent has it.  Two signatures
that differ in fewer than ``chunks * (errors + 1)`` symbols differ in at most
``errors`` symbols of some chunk (pigeonhole), so each chunk is indexed once for
every choice of the symbols that may be wrong: equal keys then find every pair
within the threshold.  Pairs over the threshold are dropped, the others are
confirmed on the full sets.

Buckets are never expanded into all pairs.  Each row of a bucket is first paired
with the bucket's least and greatest representative; components are formed of
the confirmed links.  What is left are pairs of one bucket that lie in different
components.  Their documents meet once more by their rarest shingles (prefix
filter), in blocks of a bounded size.  Each set has a parity bitmap, in which
every shingle flips one bit; two bitmaps differ in at most as many bits as the
sets differ in shingles, which rules out most that are no links before a row is
made of them.  The rest are tested too, so no link between components is lost.

With 55 symbols in 11 chunks of 5 and one error, pairs that differ in at most 21
symbols are found.  At a similarity of 0.85 the chance of more is about 6e-6, and
it falls steeply above.  Under 85 percent, there are 48 symbols in 12 chunks of 4,
of which 23 may differ; at 0.80 the chance of more is 3.3e-6.
A percent under 80 is refused.

Edge cases: a null or empty text, or one of white space, has no shingles, is
linked with nothing and kept.  Rows sharing an id are one node of the graph.  A
row with a null id is linked with nothing, its component is null, and it is
kept.  Ties: the smallest id stands for a class and a component.  An empty table
gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import drop, is_under, materialize, small_batches, tidy
from .components import components

BITS = 16


class Scheme(NamedTuple):
    """How signatures are cut and indexed."""

    chunks: int
    width: int
    errors: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        """Signatures may differ in so many symbols."""
        return self.chunks * (self.errors + 1) - 1

    @property
    def combos(self) -> list[tuple[int, tuple[int, ...]]]:
        return [(c, keep) for c in range(self.chunks) for keep in combinations(range(self.width), self.width - self.errors)]


#: By the least percent that each is for.
SCHEMES = {85: Scheme(11, 5, 1), 80: Scheme(12, 4, 1)}
CLOSE = SCHEMES[85]
SYMBOLS, DISTANCE = CLOSE.symbols, CLOSE.distance
#: Longs of a parity bitmap.
PARITY = 16
BITMAP = [f"b{i}" for i in range(PARITY)]
#: Groups of a rare shingle of more rows are dealt in blocks of so many by so many.
BLOCK = 1000
#: Ids of documents whose sets are needed are broadcast up to so many rows of 8 bytes.
BROADCAST_ROWS = 1_000_000

_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(1 << 62, size=SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(1 << 63, size=SYMBOLS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def scheme(percent: int) -> Scheme:
    """That of the greatest percent up to this one; it loses a link at its percent with a chance under 1e-5."""
    for least in sorted(SCHEMES, reverse=True):
        if percent >= least:
            return SCHEMES[least]
    raise ValueError(f"percent {percent}: signatures are sized for {min(SCHEMES)} or more")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def shingle_set(text: str | None, size: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; ASCII case is ignored."""
    words = (text or "").encode().lower().split()
    memo.room()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(len(h), size)):
        out = _mixed(out * _STEP + h[i : i + n])
    return np.unique(out)


def signature(shingles: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    least = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _FACTORS[:symbols] + _TERMS[:symbols]).min(axis=0))
    return (_mixed(least) >> np.uint64(64 - BITS)).astype("<u2")


def index_keys(signatures: np.ndarray, how: Scheme = CLOSE) -> np.ndarray:
    """One column of 64-bit keys for each chunk and each choice of symbols that must agree."""
    s = signatures.astype(np.uint64).reshape(-1, how.chunks, how.width)
    keys = []
    for i, (c, keep) in enumerate(how.combos):
        x = np.full(len(s), i + 1, np.uint64)
        for k in keep:
            x = _mixed(x * _STEP + s[:, c, k])
        keys.append(x)
    return np.stack(keys, axis=1)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profiles(size: int, how: Scheme):
    def run(batches):
        memo = word_memo()
        for b in batches:
            ids = b.column(0).to_pylist()
            n, halves, sigs = [], [], []
            for doc, text in zip(ids, b.column(1).to_pylist(), strict=True):
                s = shingle_set(text, size, memo)
                n.append(len(s))
                if len(s) and doc is not None:
                    halves.append(tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()))
                    sigs.append(signature(s, how.symbols).tobytes())
                else:  # no class: ids of their own, so that they do not meet in one task
                    halves.append((doc, None))
                    sigs.append(None)
            d1, d2 = zip(*halves, strict=True) if halves else ((), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary())], ["id", "n", "d1", "d2", "sig"])

    return run


def _index(how: Scheme):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if len(ids):
                keys = index_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, how.symbols), how)
                yield pa.record_batch([_longs(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])

    return run


def _near(how: Scheme):
    """Pairs whose signatures are within the threshold."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, how.symbols) for i in (2, 3))
                ok = pa.array((x != y).sum(axis=1) <= how.distance)
                yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


def _sets(size: int):
    def run(batches):
        memo = word_memo()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t, size, memo).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "set"])

    return run


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap in which each shingle has flipped one bit."""
    flips = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _open_sets(size: int):
    """Sets of documents, with their parity bitmaps."""

    def run(batches):
        memo = word_memo()
        for b in batches:
            sets = [shingle_set(t, size, memo) for t in b.column(1).to_pylist()]
            bits = np.stack([parity(s) for s in sets]) if sets else np.zeros((0, PARITY), np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.zeros(0, np.uint64), *sets])))
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), tokens, *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], ["id", "n", "tokens", *BITMAP])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """(a, b, value of a, value of b)"""
    one = values.select(F.col("id").alias("a"), F.col(name).alias("of_a"))
    two = values.select(F.col("id").alias("b"), F.col(name).alias("of_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these distinct ids."""
    return docs.join(F.broadcast(ids) if is_under(ids, BROADCAST_ROWS) else ids, "id", "left_semi")


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs that are links: first by signature, then by the full sets."""
    near = materialize(_with_both(pairs, reps, "sig").mapInArrow(tidy(_near(scheme(percent))), "a long, b long"), "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_only(docs, ids).mapInArrow(tidy(_sets(size)), "id long, set binary"), "sets")
    links = materialize(_with_both(near, sets, "set").mapInArrow(tidy(_confirm(percent)), "a long, b long"), "links")
    drop(near, sets)
    return links


def open_pairs(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``opened`` (id, root): all pairs of different roots that can be links, each once.

    Linked sets share one of the rarest shingles of both, of as many as a set may miss and one (prefix
    filter).  Shingles are ranked by how many of the open sets hold them; one that no other holds is in
    no pair.  So what many texts share brings no two of them together.  A shingle's rows of different
    roots meet in blocks of a bounded size, where parity bitmaps rule out most of what is left.
    """
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    ranked = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    need = F.ceil(F.col("n") * percent / 100) if percent % 100 else F.col("n")
    most = F.col("n") - need + 1 - (F.col("n") - F.size("shared"))
    prefix = ranked.join(sets.select("id", "n"), "id").filter(most > 0).select("id", F.explode(F.slice("shared", F.lit(1), most.cast("int"))).alias("x"))
    prefix = materialize(prefix.select("id", F.col("x.token").alias("token")).join(opened, "id"), "open-prefixes")
    groups = prefix.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min_by("root", "id").alias("main"), F.count(F.lit(1)).alias("rows"))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    rows = prefix.join(groups.filter("least < most").select("token", "main", blocks.alias("blocks")), "token").join(sets.drop("tokens"), "id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.select("token", F.col("own").alias("p"), every.alias("q"), "id", "root", "n", *BITMAP)
    two = rows.filter("root <> main").select(F.col("token").alias("t2"), every.alias("p2"), F.col("own").alias("q2"), *[F.col(c).alias(f"o_{c}") for c in ("id", "root", "n", *BITMAP)])
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in BITMAP])
    can = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("o_n"))
    met = (F.col("token") == F.col("t2")) & (F.col("p") == F.col("p2")) & (F.col("q") == F.col("q2"))
    out = one.join(two, met & (F.col("root") != F.col("o_root")) & can)
    return out.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; links are pairs with
    100 * intersection >= percent * union of their shingle sets."""
    spark, how = df.sparkSession, scheme(percent)
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    rows = materialize(docs.mapInArrow(tidy(_profiles(size, how)), "id long, n long, d1 long, d2 long, sig binary"), "profiles")
    reps = materialize(rows.filter("sig is not null").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "classes")
    keys = materialize(reps.select("id", "sig").mapInArrow(tidy(_index(how)), "key long, id long"), "index")
    ends = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(keys.join(ends, "key"), "buckets")
    drop(keys)
    stars = members.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p"))
    pairs = materialize(stars.select("p.a", "p.b").filter("a < b").distinct(), "pairs")
    links = _links(pairs, reps, docs, size, percent)
    roots = components(links)

    # Pairs of one bucket that the stars have not tested and the links do not connect.
    root = F.coalesce(F.col("root"), F.col("id"))
    placed = members.filter("n > 2").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", root.alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    opened = materialize(placed.join(mixed.select("key"), "key", "left_semi").select("id", "root").distinct(), "open-documents")
    schema = "id long, n long, tokens array<long>, " + ", ".join(f"{c} long" for c in BITMAP)
    sets = materialize(_only(docs, opened.select("id")).mapInArrow(tidy(_open_sets(size)), schema), "open-sets")
    left = open_pairs(opened, sets, percent).join(pairs, ["a", "b"], "left_anti")
    more = _links(materialize(left, "open-pairs"), reps, docs, size, percent)
    if not more.isEmpty():
        roots = components(links.union(more))
    drop(members, pairs, opened, sets)

    classes = reps.join(roots.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", root.alias("root"))
    out = rows.drop("sig").join(classes, ["d1", "d2"], "left")
    component = F.coalesce(F.col("root"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
