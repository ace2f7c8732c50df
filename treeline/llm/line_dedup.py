"""Line dedup with two Bloom filters.

1. One scan writes a 128-bit digest for each document and distinct line key.
2. The first half of each digest goes to the task that owns it (each task first
   drops what it has sent twice), which keeps two Bloom filters: hashes seen
   once, and seen twice.  A hash found in the first is a suspect, and is put
   into the second so that it is named once.
3. Only rows of suspects shuffle to be counted exactly by the whole digest, and
   to choose the document that keeps the line.
4. Each document gets the digests it must drop, and its lines are written anew.

False positives of the filters cost a row in step 3 and never change a result;
there are no false negatives.  The filters hold eight million hashes a task and
the number of tasks follows the number of rows.  Keys are compared by 128-bit
BLAKE2b digests.

Edge cases: a null or empty text is one empty line.  Rows that share an id are
one document; rows with a null id count for no key and lose no line.  Ties cannot
occur: the largest id keeps.  An empty table gives an empty table.  Other columns
ride along and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, is_under, materialize, small_batches, tidy

#: ASCII letters to lower case; white space stripped at both ends (fixed values).
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHORTEST, FEWEST = 20, 3
FILTER_BITS, HASHES, PER_FILTER = 1 << 26, 5, 8_000_000
#: Suspects are broadcast up to so many rows of 8 bytes.
BROADCAST_ROWS = 1_000_000


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(LOWER)


def key_digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


class Bloom:
    def __init__(self, bits: int = FILTER_BITS):
        self.mask = np.uint64(bits - 1)
        self.cells = np.zeros(bits >> 3, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        a, b = hashes >> np.uint64(32), hashes | np.uint64(1)
        return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * (b ^ (b >> np.uint64(29)))[:, None]) & self.mask

    def has(self, places: np.ndarray) -> np.ndarray:
        return ((self.cells[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.cells, (places >> np.uint64(3)).ravel(), (np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)).ravel())


def _digests(batches):
    for b in batches:
        ids, halves = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if doc is None or not text:
                continue
            keys = {k for k in map(line_key, text.split("\n")) if len(k) >= SHORTEST}
            ids += [doc] * len(keys)
            halves += map(key_digest, keys)
        both = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["id", "h1", "h2"])


def _seen_here(batches):
    """Each hash at most twice from a task, or from each 250,000 of its hashes."""
    sent: dict[int, int] = {}

    def out():
        rows = np.fromiter((h for h, n in sent.items() for _ in range(n)), np.int64)
        sent.clear()
        return pa.record_batch([pa.array(rows)], ["h1"])

    for b in batches:
        for h in b.column(0).to_pylist():
            sent[h] = min(2, sent.get(h, 0) + 1)
        if len(sent) > 250_000:
            yield out()
    yield out()


def _suspects(batches):
    once, twice, held = Bloom(), Bloom(), []

    def look(parts):
        hashes, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
        at = once.places(hashes)
        again = (counts > 1) | once.has(at)
        once.add(at)
        fresh = again & ~twice.has(at)
        twice.add(at[fresh])
        return pa.record_batch([pa.array(hashes[fresh].view(np.int64))], ["h1"])

    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False))
        if sum(map(len, held)) >= 65536:
            yield look(held)
            held = []
    if held:
        yield look(held)


def _rewrite(batches):
    for b in batches:
        kept, lines_in, lines_out = [], [], []
        for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            left = lines
            if gone:
                gone = {(x["h1"], x["h2"]) for x in gone}
                left = []
                for line in lines:
                    key = line_key(line)
                    if len(key) < SHORTEST or tuple(np.frombuffer(key_digest(key), "<i8").tolist()) not in gone:
                        left.append(line)
            kept.append("\n".join(left))
            lines_in.append(len(lines))
            lines_out.append(len(lines) - len(left))
        yield pa.record_batch([b.column(0), pa.array(kept, pa.string()), pa.array(lines_in, pa.int64()), pa.array(lines_out, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST) -> DataFrame:
    """(row, kept, n_lines, n_dropped): ``row`` is a struct of the columns other than the text."""
    spark = df.sparkSession
    small_batches(spark)
    pairs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    keys = materialize(pairs.mapInArrow(tidy(_digests), "id long, h1 long, h2 long"), "line-keys")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // PER_FILTER + 1)
    sent = keys.select("h1").mapInArrow(tidy(_seen_here), "h1 long").repartition(tasks, "h1")
    suspects = materialize(sent.mapInArrow(tidy(_suspects), "h1 long"), "line-suspects").distinct()
    few = is_under(suspects, BROADCAST_ROWS)
    again = materialize(keys.join(F.broadcast(suspects) if few else suspects, "h1"), "line-repeats")
    counted = again.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= fewest)
    loses = again.join(counted, ["h1", "h2"]).filter("id <> keeper").groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    loses = materialize(loses, "line-losses")
    drop(keys, again)
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    rows = df.select(F.col(id_col).cast("long").alias("id"), rest.alias("row"), F.col(text_col).alias("t")).join(loses, "id", "left").select("row", "t", "gone")
    out = T.StructType([rows.schema["row"], T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.mapInArrow(tidy(_rewrite), out)
