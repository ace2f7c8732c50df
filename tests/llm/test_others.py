"""Chats, archives, pseudonyms, the contract queries and the pipeline."""

import base64
import hashlib
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from treeline.llm import chat_format as chat
from treeline.llm import oracles, pii, queries, warc

from ..compare import same
from ..conftest import SF
from .test_documents import ITEMS, brute_components, brute_hits, brute_lines, brute_repeats


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_duckdb(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, oracles.SQL[name])


# --- chats


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\\[INST]b"]), st.text(alphabet="ab\\<>/s[]INT \n", max_size=30)), max_size=5))
def test_turns_round_trip(turns):
    text, mask = chat.render(turns)
    assert chat.read_back(text) == turns
    assert "".join(chat.unescape(text[s:e]) for s, e in mask) == "".join(t for r, t in turns if r == "assistant")


def nodes(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score long")


def test_best_branches(spark):
    rows = [(1, 1, None, "user", "q", 0), (1, 2, 1, "assistant", "a", 5), (1, 3, 1, "assistant", "b", 2), (1, 4, 3, "user", "c", 9), (1, 5, 3, "user", "d", 9), (2, 1, 77, None, None, 1), (None, 1, None, "user", "n", 0)]
    out = {(r.tree, r.leaf): chat.read_back(r.formatted) for r in chat.format_trees(nodes(spark, rows), keep=2).collect()}
    assert out == {(1, 4): [("user", "q"), ("assistant", "b"), ("user", "c")], (1, 5): [("user", "q"), ("assistant", "b"), ("user", "d")], (2, 1): [("", "")], (None, 1): [("user", "n")]}


def test_deep_tree_and_cycle(spark):
    deep = [(1, i, i - 1 if i > 1 else None, "user", str(i), 1) for i in range(1, 301)]
    out = chat.format_trees(nodes(spark, deep)).collect()
    assert [t for _, t in chat.read_back(out[0].formatted)] == [str(i) for i in range(1, 301)]
    with pytest.raises(Exception, match="cycle"):
        chat.format_trees(nodes(spark, [(1, 1, 2, "u", "", 1), (1, 2, 1, "u", "", 1), (1, 3, 1, "u", "", 1)])).collect()
    assert chat.format_trees(nodes(spark, [])).count() == 0


def test_long_chain_and_random_trees(spark):
    """Chains beyond what paths in every node could hold, and trees against a walk in plain Python."""
    import random

    chain = [(1, i, i - 1 if i else None, "user", "x", 1) for i in range(20_000)]
    out = chat.format_trees(nodes(spark, chain)).first()
    assert len(chat.read_back(out.formatted)) == 20_000 and out.leaf == 19_999
    r = random.Random(2)
    rows = [(t, i, r.choice([None, *range(i)] if i else [None]), r.choice(["user", "assistant"]), f"{t}.{i}", r.choice([None, -1, 0, 3])) for t in range(6) for i in range(40)]
    by = {(t, i): (p, role, text, s or 0) for t, i, p, role, text, s in rows}

    def way(t, i):
        return [] if i is None else [*way(t, by[t, i][0]), i]

    want = {}
    for t in range(6):
        ends = set(range(40)) - {p for (u, _), (p, *_) in by.items() if u == t}
        for leaf in sorted(ends, key=lambda i: (-sum(by[t, n][3] for n in way(t, i)), i))[:3]:
            want[t, leaf] = [by[t, n][1:3] for n in way(t, leaf)]
    out = chat.format_trees(nodes(spark, rows), keep=3).collect()
    assert {(x.tree, x.leaf): chat.read_back(x.formatted) for x in out} == want


def test_repeated_turns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, None, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, node long")
    out = chat.format_trees(chat.from_turns(df)).first()
    assert chat.read_back(out.formatted) == [("user", "x"), ("user", "x"), ("", "")]


# --- archives


def test_archive(spark, tmp_path):
    same_ = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n é"
    rows = [(1, "http://a/\r\nx", same_), (5, None, same_), (3, "u", same_), (3, "u", same_), (None, "v", same_), (7, "w", None), (8, "w", ""), (9, "z", "long " * 100_000), (5, "again", same_)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    p = f"file://{tmp_path}/a"
    warc.write_archive(df, p)
    out = warc.reconstruct(warc.read_archive(spark, p, with_payload=True)).collect()
    got = sorted((repr(r.id), r.record_type, repr(r.refers_to), bytes(r.payload).decode(), r.n_bytes) for r in out)
    largest, one = {same_: 5, "": 8, "long " * 100_000: 9}, [r for r in out if r.id == 5]
    assert sorted(r.record_type for r in one) == ["response", "revisit"]
    want = []
    for i, u, h in rows:
        h = h or ""
        again = i is not None and (i != largest[h] or any(r.record_type == "revisit" and r.url == (u or "") for r in one if i == 5))
        want.append((repr(i), "revisit" if again else "response", repr(largest[h] if again else None), h, len(h.encode())))
    assert got == sorted(want)
    assert all(r.digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() for r in out)
    files = [f.read_bytes() for f in (tmp_path / "a").glob("part-*")]
    whole = [m for f in files for m in warc.members(memoryview(f))]
    assert len(whole) == len(rows)  # a member each
    assert b"".join(whole) == b"".join(__import__("gzip").decompress(f) for f in files)
    assert sorted(whole) == sorted(bytes(r.record) + b"\r\n\r\n" for r in out)


def test_large_pages_and_files_by_bytes(spark, tmp_path):
    big = os.urandom(9_000_000).hex()
    df = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", big[::-1]), (4, "x", "small")], "page_id long, url string, html string").coalesce(1)
    p = f"file://{tmp_path}/a"
    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc, "FILE_BYTES", 1_000_000)  # read by forked workers
        warc.write_archive(df, p)
    out = {r.id: (r.record_type, bytes(r.payload).decode()) for r in warc.reconstruct(warc.read_archive(spark, p, with_payload=True)).collect()}
    assert out == {1: ("revisit", big), 2: ("response", big), 3: ("response", big[::-1]), 4: ("response", "small")}


def test_payloads_of_one_weak_digest_stay_two(spark):
    schema = warc.HEADERS + ", payload binary"
    rows = [(i, kind, None, "u", "SAME", strong, b"h", b"t", 1 if body else None, body) for i, kind, strong, body in [(1, "response", "a", b"x"), (2, "response", "b", b"y"), (3, "revisit", "b", None)]]
    out = {r.id: bytes(r.payload) for r in warc.reconstruct(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: b"x", 2: b"y", 3: b"y"}


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    p = f"file://{tmp_path}/a"
    warc.write_archive(df, p, smallest=3)
    assert {r.id: r.record_type for r in warc.read_archive(spark, p).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_damage_is_found(spark, tmp_path):
    import gzip

    p = tmp_path / "a"
    warc.write_archive(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), f"file://{p}")
    f = next(x for x in p.glob("part-*") if x.stat().st_size > 50)
    f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"payload", b"PAYLOAD")))
    os.remove(p / f".{f.name}.crc")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, f"file://{p}").collect()


def test_empty_archive(spark, tmp_path):
    p = f"file://{tmp_path}/a"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), p)
    assert warc.read_archive(spark, p).count() == 0


# --- pseudonyms


@pytest.mark.parametrize("a,b", [(27, 31), (1, 40), (100, 7)])
def test_feistel_is_a_permutation(spark, a, b):
    out = [r[0] for r in spark.range(a * b).select(pii.feistel(F.col("id"), a, b, "k", "t")).collect()]
    assert sorted(out) == list(range(a * b))
    assert out != list(range(a * b))


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_formats_stay_and_values_stay_linked(spark):
    import re

    card = "4425414259157784"
    texts = [f"a {card} b", f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", "4425414259157785", "+1 (873) 555-4781", "(873) 555-4781", "10.0.0.1", "666-12-3456 123-45-6789", "2020-02-29 2021-02-29", "Jo.Ann9@x.org", None, "", "plain v1.2.3.4.5 text", "x4425414259157784"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kinds", F.lit(1))
    out = [r for r in pii.pseudonymize(df, "key").orderBy("doc_id").collect()]
    t = [r.text for r in out]
    new = t[0].split()[1]
    assert new != card and luhn(new) and t[1].replace(" ", "") == new and t[2] == texts[2]
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", t[3]) and t[3] != texts[3] and t[4] == t[3][3:]
    assert re.fullmatch(r"\d+(\.\d+){3}", t[5]) and t[5] != texts[5]
    assert t[6].startswith("666-12-3456 ") and re.fullmatch(r"\d{3}-\d\d-\d{4}", t[6].split()[1]) and t[6] != texts[6]
    assert t[7].endswith(" 2021-02-29") and t[7] != texts[7]
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@x\.org", t[8])
    assert t[9:] == texts[9:] and [r.kinds for r in out[9:]] == [[]] * 4
    other = [r.text for r in pii.pseudonymize(df, "another key").orderBy("doc_id").collect()]
    assert all(x != y for x, y in zip(t[:2] + t[3:6], other[:2] + other[3:6], strict=True))
    assert pii.pseudonymize(df.filter("false"), "key").count() == 0


@pytest.mark.parametrize("low", [0, 5_000_000, 898 * 99 * 9999 - 300])
def test_social_security_numbers_are_numbered_without_gaps(spark, low):
    rows = spark.range(low, low + 300).select(pii._ssn_text(F.col("id")).alias("m"))
    out = rows.select("m", pii.ssn(F.col("m"), "k").alias("n")).collect()
    import re

    valid = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
    assert all(valid.fullmatch(r.m) and valid.fullmatch(r.n) for r in out)
    assert len({r.m for r in out}) == len({r.n for r in out}) == 300


def plain_feistel(x, a, b, key, kind):
    p, q = divmod(x, b)
    noise = lambda *parts: int(hashlib.sha256("|".join(map(str, (key, *parts))).encode()).hexdigest()[:15], 16)
    for r in range(8):
        if r % 2:
            q = (q + noise(kind, r, p)) % b
        else:
            p = (p + noise(kind, r, q)) % a
    return p * b + q


def plain_value(kind, m, key):
    """What is written for a match, by plain Python."""
    import datetime
    import string

    only = [c for c in m if c in string.digits]
    fill = lambda chars, new: "".join(next(new) if c in chars else c for c in m)
    if kind == "email":
        local, host = m.split("@")
        chars = [c for c in local if c in string.ascii_letters + string.digits]
        p, q = chars[: len(chars) // 2], chars[len(chars) // 2 :]
        for r in range(8):
            half, other = (q, p) if r % 2 else (p, q)
            h = hashlib.sha256("|".join([key, "email", str(r), str(len(half)), "".join(other)]).encode()).hexdigest()
            for i, c in enumerate(half):
                a = next(a for a in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if c in a)
                half[i] = a[(a.index(c) + int(hashlib.sha256(f"{h}|{i}".encode()).hexdigest()[:15], 16)) % len(a)]
        new = iter(p + q)
        return "".join(next(new) if c in string.ascii_letters + string.digits else c for c in local) + "@" + host
    if kind == "phone":
        d = "".join(only)
        x = f"{plain_feistel(int(d[-9:-7] + d[-6:-4] + d[-4:]), 10**4, 10**4, key, 'phone'):08}"
        return fill(string.digits, iter(d[:-9] + x[:2] + d[-7] + x[2:]))
    if kind == "ip":
        x = plain_feistel(int.from_bytes(bytes(map(int, m.split(".")))), 1 << 16, 1 << 16, key, "ip")
        return ".".join(map(str, x.to_bytes(4)))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        x = plain_feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
        area, group = divmod(x // 9999, 99)
        return f"{area + 1 + (area + 1 >= 666):03}-{group + 1:02}-{x % 9999 + 1:04}"
    if kind == "date":
        layout = {"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}[next(c for c in m if not c.isdigit())]
        try:
            day = (datetime.datetime.strptime(m, layout).date() - datetime.date(1800, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= day < 146097:
            return m
        return (datetime.date(1800, 1, 1) + datetime.timedelta(plain_feistel(day, 27, 5411, key, "date"))).strftime(layout)
    d = "".join(only)
    if not luhn(d):
        return m
    n = len(d) - 2
    body = d[0] + f"{plain_feistel(int(d[1:-1]), 10 ** (n // 2), 10 ** (n - n // 2), key, f'card{len(d)}'):0{n}}"
    return fill(string.digits, iter(next(body + c for c in string.digits if luhn(body + c))))


def plain_pseudonyms(text, key):
    import re

    parts, kinds, at = [], [], 0
    for m in re.finditer(pii.ALL, text):
        kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, m[0], re.ASCII))
        new = plain_value(kind, m[0], key)
        parts += [text[at : m.start()], new]
        at = m.end()
        if kind not in ("card", "date") or new != m[0]:
            kinds.append(kind)
    return "".join([*parts, text[at:]]), kinds


def test_pseudonyms_against_plain_python(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [
        "Ab.c-9@x.1.co-m.y2 a@b.c a@b.co1.d2.org9 %@x.yy 1@-.-.zz", "x@a..com x@a.com. X_Y@a.b1.cc-d", "12/31/1999 31.12.2199 1800-01-01 1799-12-31 02/29/2000 2000-13-01 30.02.2000",
        "4111 1111 1111 1111 4111-1111-1111-1111 4222222222222 6304000000000000000 378282246310005", "+1 212-555-0199 (212)555.0199 +1.212.555.0199", "255.255.255.255 0.0.0.0 256.1.1.1", "899-99-9999 665-01-0001 667-01-0001 001-01-0001",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.kinds) for r in pii.pseudonymize(df, "k1").collect()}
    want = {i: plain_pseudonyms(t, "k1") for i, t in enumerate(texts) if t is not None}
    assert {i: v for i, v in got.items() if texts[i] is not None} == want
    assert {k for _, ks in want.values() for k in ks} == set(pii.KINDS)


def test_very_long_values(spark):
    """Hosts of many labels, long local parts, long runs of digits and texts of a megabyte: in proportion, and no deep stacks."""
    import time

    hosts = ["a@" + "b1." * 20_000 + "com", "a@" + "1." * 20_000 + "com", "a@" + "bb." * 20_000 + "com", "a@" + "1." * 20_000 + "9"]
    texts = [*hosts, "x" * 100_000 + "@a.org", "x@y." * 100_000, "1" * 1_000_000, "a" * 1_000_000, "some words " * 100_000 + "me@x.org", "1.2." * 200_000, "1-" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.text, r.kinds) for r in pii.pseudonymize(df, "k1").collect()}
    assert time.time() - began < 60
    assert got == {i: plain_pseudonyms(t, "k1") for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(5)] == [["email"]] * 3 + [[]] + [["email"]]


# --- pipeline


def test_pipeline(spark, tmp_path):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = [" ".join(word() for _ in range(r.randint(25, 80))) for _ in range(40)]
    item = ITEMS[0][1]
    texts += [texts[0], texts[1] + " more", texts[2].upper(), "too short", "", None, " ".join(["same words again and again for ever and"] * 9)]
    texts += [f"{texts[3 + i]}\nA line that is shared by several documents\n{texts[20 + i]}" for i in range(4)]
    texts += [item + " " + " ".join(word() for _ in range(30)), item + " " + " ".join(word() for _ in range(900))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(ITEMS[:2] + ITEMS[3:4], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {x.doc_id: (x.n_tokens, x.ids, x.decoded) for x in corpus_pipeline.run(spark, sf).collect()}

    left = [(i, t) for i, t, *_ in rows if t and len(t.split()) >= 20 and 100 * brute_repeats(t) <= 30 * len(t.split())]
    left = [(i, t) for i, _, _, t in brute_lines(left)]
    near = brute_components(left, 80)
    left = [(i, t) for i, t in left if near[i][2]]
    for i, t in list(left):
        n, hit, whole, _ = brute_hits(t, ITEMS[:2] + ITEMS[3:4])
        if whole or (hit and 20 * hit >= n):
            left.remove((i, t))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(e.ids), e.ids, t) for i, t in left for e in [lib.encode(t, add_special_tokens=False)]}
    assert got == want
    assert 0 < len(want) < len(rows)
    assert not {i for i, t, *_ in rows if t and item in t} & set(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
