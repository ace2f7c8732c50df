"""Encoding and repair of striped files."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reed_solomon as rs


def encode(files: DataFrame, n: int = 6, unit: int = 64) -> DataFrame:
    """(doc_id, idx, data): the n data and three parity columns of each file; one scan, no shuffle."""

    def run(batches):
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = rs.stripe(content or b"", n, unit)
                rows = [c.tobytes() for c in np.concatenate([data, rs.encode(data)])]
                yield pa.record_batch([pa.array([doc] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "idx", "data"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, idx int, data binary")


def repair(stripes: DataFrame, n: int = 6, unit: int = 64) -> DataFrame:
    """(doc_id, content, recovered): files from the columns that are left, null if more than three are gone.

    A file's columns are at most n + 3 rows, so its group is bounded.
    """

    def run(batches):
        for b in batches:
            out = []
            for doc, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have = {p["idx"]: np.frombuffer(p["data"], np.uint8) for p in parts}
                lost = [i for i in range(n + rs.PARITY) if i not in have]
                if len(lost) > rs.PARITY:
                    out.append((doc, None, len(lost)))
                    continue
                width = len(next(iter(have.values())))
                blocks = np.stack([have.get(i, np.zeros(width, np.uint8)) for i in range(n + rs.PARITY)])
                out.append((doc, rs.unstripe(rs.decode(blocks, lost)[:n], n * width, unit), len(lost)))
            ids, data, lost = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(lost, pa.int32())], ["doc_id", "content", "recovered"])

    rows = stripes.groupBy("doc_id").agg(F.collect_list(F.struct("idx", "data")).alias("parts"))
    return rows.mapInArrow(run, "doc_id long, content binary, recovered int")


def parity_digests(files: DataFrame, n: int = 6, unit: int = 64) -> DataFrame:
    """(doc_id, p, q, r): MD5 of each parity column."""

    def run(batches):
        for b in batches:
            rows = []
            for content in b.column(1).to_pylist():
                rows.append([hashlib.md5(x.tobytes()).hexdigest() for x in rs.encode(rs.stripe(content or b"", n, unit))])
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.string()) for c in cols)], ["doc_id", "p", "q", "r"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, p string, q string, r string")
