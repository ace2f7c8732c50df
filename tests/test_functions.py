import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.functions import checksums as cs
from treeline.functions import reed_solomon as rs
from treeline.functions import text as T
from treeline.streaming.retention import cascade


def test_adler_golden(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(cs.adler32("b")).collect()] == [38600999, 1, None]


def test_adler_combine(spark):
    rows = [(zlib.adler32(b"x" * n), zlib.adler32(b"yz" * m), 2 * m, zlib.adler32(b"x" * n + b"yz" * m)) for n in (0, 1, 70000) for m in (0, 3, 50000)]
    df = spark.createDataFrame(rows, "a long, b long, n long, want long")
    assert df.filter(cs.adler32_combine(F.col("a"), F.col("b"), F.col("n")) != F.col("want")).count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_every_pattern_of_three_losses(n):
    rng = np.random.default_rng(n)
    for data in (np.zeros((n, 32), np.uint8), rng.integers(0, 256, (n, 32), dtype=np.uint8)):
        blocks = np.concatenate([data, rs.encode(data)])
        for k in range(1, 4):
            for lost in combinations(range(n + 3), k):
                broken = blocks.copy()
                broken[list(lost)] = 0xAA
                assert (rs.decode(broken, list(lost)) == blocks).all()


def test_four_losses_are_an_error():
    with pytest.raises(ValueError):
        rs.decode(np.zeros((9, 16), np.uint8), [0, 1, 2, 3])


@pytest.mark.parametrize("n,m", [(1, 1), (4, 2), (3, 4), (10, 5)])
def test_any_number_of_parities(n, m):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 256, (n, 16), dtype=np.uint8)
    blocks = np.concatenate([data, rs.encode_any(data, m)])
    for lost in combinations(range(n + m), m):
        broken = blocks.copy()
        broken[list(lost)] = 0
        assert (rs.decode_any(broken, m, list(lost)) == blocks).all()


@given(st.binary(max_size=3000), st.integers(1, 7))
def test_stripes_round_trip(data, n):
    assert rs.unstripe(rs.stripe(data, n, 64), len(data), 64) == data


@given(st.text(max_size=40))
def test_escape_round_trip(s):
    one = lambda f, x: f.func(__import__("pandas").Series([x]))[0]
    hidden = one(cs.escape, s)
    assert "/" not in hidden and one(cs.unescape, hidden) == s


def test_scrub():
    f = cs.chunk_file(5, 9, 2, b"data" * 40000)
    assert cs.scrub_one("/d/5.9.2", f) == "ok"
    assert cs.scrub_one("/d/5.9.3", f) == "name mismatch"
    assert cs.scrub_one("5.9", f) == "malformed name"
    assert cs.scrub_one("5.9.2", f[:100]) == "invalid size"
    assert cs.scrub_one("5.9.2", f[:-1] + b"!") == "checksum mismatch in block 2"
    assert cs.scrub_one("5.9.2", struct.pack("<I", 1) + f[4:]) == "bad magic"


def test_human_size(spark):
    want = {0: "0 KB", 1536: "1.5 KB", 1048576: "1 MB", 1023: "1 KB", -5: "0 KB", 1 << 30: "1 GB", 1077: "1.05 KB"}
    df = spark.createDataFrame([(k,) for k in want], "n long").select("n", T.human_size(F.col("n")).alias("h"))
    assert {r.n: r.h for r in df.collect()} == want


@pytest.mark.parametrize("change,mode,is_dir,want", [("644", 0, False, 0o644), ("u+rwx,g-w,o=r", 0o070, False, 0o754), ("a+X", 0o600, False, 0o600), ("a+X", 0o600, True, 0o711), ("+t", 0o755, True, 0o1755), ("go=", 0o777, False, 0o700)])
def test_chmod(spark, change, mode, is_dir, want):
    df = spark.createDataFrame([(mode, is_dir)], "m long, d boolean")
    assert df.select(T.chmod(F.col("m"), F.col("d"), change)).first()[0] == want


def test_sticky_mode(spark):
    df = spark.createDataFrame([(0o1755,), (0o1754,)], "m long")
    assert [r[0] for r in df.select(T.mode_string(F.col("m"))).collect()] == ["rwxr-xr-t", "rwxr-xr-T"]


@pytest.mark.parametrize("pattern,path,hit", [("/a/*", "/a/b", True), ("/a/*", "/a/.b", False), ("/a/*", "/a/b/c", False), ("/a?c", "/abc", True), ("/[!x]b", "/ab", True), ("/[!x]b", "/xb", False), ("/a[b", "/a[b", True)])
def test_glob(pattern, path, hit):
    import re

    assert bool(re.search(T.glob_regex(pattern), path)) is hit


def test_object_key_drops_a_byte():
    import pandas as pd

    f = lambda *a: cs.object_key.func(*[pd.Series([x]) for x in a])[0]
    assert f(1, 2, 3, 4) == "2.3.4"
    assert f(1, 2, 3, -4).count(".") == 4 and f(1, 3, 3, -4).count(".") == 3
    assert f(1 << 60, 2, 3, -4) == f(0, 2, 3, -4)


def test_cascade_keeps_every_list_short():
    lists = cascade([(t, t) for t in range(0, 200_000, 10)])
    # The last list holds what is older than 300 s, an hour and a day together: 110,000 s, a day apart.
    assert [len(x) for x in lists] == [30, 30, 24, 2]
    assert all(b[0] - a[0] >= span for x, (_, span) in zip(lists, ((30, 10), (30, 120), (24, 3600), (30, 86400)), strict=True) for a, b in zip(x, x[1:], strict=False))


def test_readable_bytes(spark):
    cases = [(0, "0.00&nbsp;bytes"), (1 << 20, "1048576.00&nbsp;bytes"), ((1 << 20) + 131072, "1.12&nbsp;MB"), (3 * (1 << 17) * 3, "1.12&nbsp;MB"), ((1 << 30) - 1, "1024.00&nbsp;MB"), (5 << 50, "5.00&nbsp;PB"), (None, None)]
    df = spark.createDataFrame(cases, "v long, want string")
    assert [r for r in df.select("v", T.readable_bytes(F.col("v")).alias("got"), "want").collect() if r.got != r.want] == []


def test_parse_iso(spark):
    cases = [("1970-01-01T00:00:00.000001Z", 1), ("1969-12-31T23:59:59.999999Z", -1), ("2016-02-29T04:11:44.429777Z", 1456719104429777), ("2015-02-29T00:00:00.000000Z", None), ("2016-02-06T24:00:00.000000Z", None), ("2016-02-06 04:11:44.429777Z", None), ("2016-02-06T04:11:44.429777Z\n", None), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "s string, want long")
    assert [r for r in df.select("s", T.parse_iso(F.col("s")).alias("got"), "want").collect() if r.got != r.want] == []


def test_override(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), ({}, {"a": "1"}), ({"a": "1"}, {})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in df.select(T.override(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": None, "c": "3"}, {"a": "1"}, {"a": "1"}]


def test_listed_object(spark):
    df = spark.createDataFrame([("<L><Contents><Key>a&amp;b</Key><Size>7</Size></Contents></L>",), ("<L></L>",)], "x string")
    rows = df.select(T.listed_object(F.col("x")).alias("o")).select("o.Key", "o.Size").collect()
    assert [tuple(r) for r in rows] == [("a&b", 7), (None, None)]


def test_inflate(spark):
    import gzip

    raw = [b"", b"\x1f", b"plain", gzip.compress(b""), gzip.compress(b"a") + gzip.compress(b"b"), None]
    df = spark.createDataFrame([(b,) for b in raw], "b binary").coalesce(1)
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(cs.inflate("b")).collect()] == [b"", b"\x1f", b"plain", b"", b"ab", None]
