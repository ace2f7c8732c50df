"""Checksums, names and hashes of bytes.

Arrow-batched functions where no built-in has the algorithm; plain expressions
for everything that is arithmetic.
"""

from __future__ import annotations

import base64
import gzip
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ADLER_MODULUS, CHECKSUM_BLOCK


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    return data.map(zlib.adler32, na_action="ignore").astype("Int64")


def block_adler32(size: int = CHECKSUM_BLOCK):
    """The checksum of each block of ``size`` bytes; none for no bytes."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def blocks(data: pd.Series) -> pd.Series:
        return data.map(lambda b: [zlib.adler32(b[i : i + size]) for i in range(0, len(b), size)], na_action="ignore")

    return blocks


def adler32_combine(first: Column, second: Column, length: Column) -> Column:
    """The checksum of two byte strings together, from their own and the second's length."""
    m = ADLER_MODULUS
    low = lambda c: c.bitwiseAND(0xFFFF)
    high = lambda c: F.shiftright(c, 16)
    a = (low(first) + low(second) + m - 1) % m
    b = (length % m * low(first) + high(first) + high(second) + m - length % m) % m
    return b * 65536 + a


def block_geometry(offset: Column, size: int = CHECKSUM_BLOCK) -> dict[str, Column]:
    block = F.call_function("div", offset, F.lit(size).cast("long"))
    return {"block": block, "start": block * size, "end": (block + 1) * size}


def _super_fast_hash(data: bytes) -> int:
    """The 32-bit name hash; the odd last byte is taken as signed."""
    if not data:
        return 0
    m = 0xFFFFFFFF
    h, n = len(data), len(data) // 4
    signed = lambda b: b - 256 if b > 127 else b
    for low, high in struct.iter_unpack("<HH", data[: 4 * n]):
        h = (h + low) & m
        h = ((h << 16) ^ (high << 11) ^ h) & m
        h = (h + (h >> 11)) & m
    tail = data[4 * n :]
    if len(tail) >= 2:
        h = (h + struct.unpack("<H", tail[:2])[0]) & m
    if len(tail) == 3:
        h ^= (h << 16) & m
        h ^= (signed(tail[2]) << 18) & m
        h = (h + (h >> 11)) & m
    elif len(tail) == 2:
        h ^= (h << 11) & m
        h = (h + (h >> 17)) & m
    elif len(tail) == 1:
        h = (h + signed(tail[0])) & m
        h ^= (h << 10) & m
        h = (h + (h >> 1)) & m
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h ^= (h << left) & m
        h = (h + (h >> right)) & m
    return h


@F.pandas_udf(T.LongType())
def name_hash(name: pd.Series) -> pd.Series:
    return name.map(lambda s: _super_fast_hash(s.encode()), na_action="ignore").astype("Int64")


def directory_order(name_hash_: Column) -> Column:
    """Entries of a directory are kept in the order of their hash, which leaves four bits for ties."""
    return F.shiftleft(name_hash_, 4)


def url_safe(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


@F.pandas_udf(T.StringType())
def object_key(fs_id: pd.Series, file_id: pd.Series, block_id: pd.Series, version: pd.Series) -> pd.Series:
    """The name of a chunk file, or for a negative version of a block in an object store.

    The suffix has one byte less than the file system id, as existing stores have it.
    """

    def one(fs: int, fid: int, cid: int, ver: int) -> str:
        if ver >= 0:
            return f"{fid}.{cid}.{ver}"
        crc = url_safe(struct.pack("<I", zlib.crc32(struct.pack("<qq", cid, ver))))
        name = f"{cid}.{ver}" if fid == cid else f"{fid}.{cid}.{ver}"
        return f"{crc}.{name}" + (f".{url_safe(struct.pack('<q', fs)[:-1])}" if fs >= 0 else "")

    return pd.Series([one(*map(int, row)) for row in zip(fs_id, file_id, block_id, version, strict=True)], dtype=object)


#: Characters that log entries cannot hold, beside control characters (fixed value).
ESCAPED = "%=;/,"


@F.pandas_udf(T.StringType())
def escape(text: pd.Series) -> pd.Series:
    hide = lambda s: "".join(f"%{ord(c):02X}" if c < " " or c in ESCAPED else c for c in s)
    return text.map(hide, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    from urllib.parse import unquote

    return text.map(unquote, na_action="ignore")


#: The header of a chunk file: magic, version, file, chunk, chunk version, size, 1024 block checksums (fixed values).
HEADER = struct.Struct("<IIQQQQ1024I")
HEADER_SIZE, MAGIC = 4400, 0xCAFECAFE


def scrub_one(name: str, content: bytes, block: int = CHECKSUM_BLOCK) -> str:
    """'ok', or what is wrong with a chunk file named file.chunk.version."""
    parts = name.rsplit("/", 1)[-1].split(".")
    if len(parts) != 3 or not all(p.lstrip("-").isdigit() for p in parts):
        return "malformed name"
    if len(content) < HEADER_SIZE:
        return "invalid size"
    magic, _, fid, cid, ver, size, *sums = HEADER.unpack_from(content)
    if magic != MAGIC:
        return "bad magic"
    if [fid, cid, ver] != [int(p) for p in parts]:
        return "name mismatch"
    data = content[HEADER_SIZE : HEADER_SIZE + size]
    if len(data) != size or size > 1024 * block:
        return "invalid size"
    for i in range(0, size, block):
        if zlib.adler32(data[i : i + block].ljust(block, b"\0")) != sums[i // block]:
            return f"checksum mismatch in block {i // block}"
    return "ok"


def chunk_file(fid: int, cid: int, version: int, data: bytes, block: int = CHECKSUM_BLOCK) -> bytes:
    """A chunk file with its header."""
    sums = np.zeros(1024, np.uint32)
    for i in range(0, len(data), block):
        sums[i // block] = zlib.adler32(data[i : i + block].ljust(block, b"\0"))
    return HEADER.pack(MAGIC, 1, fid, cid, version, len(data), *sums.tolist()).ljust(HEADER_SIZE, b"\0") + data


@F.pandas_udf(T.StringType())
def scrub(name: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([scrub_one(n, c) for n, c in zip(name, content, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """Bytes that start with the gzip magic, inflated, all members of them; others as they are."""
    return data.map(lambda b: gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b, na_action="ignore")
