"""Operators on documents against brute force, and their edge cases."""

import hashlib
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from treeline.llm import decontaminate as decon
from treeline.llm import minhash, quality_rules, secret_scan
from treeline.llm.components import components
from treeline.llm.line_dedup import Bloom, line_dedup, line_key

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_words int, id string, pos int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    return rows + [(10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "word " * 30_000), (None, rows[0][1]), rows[1], rows[1]]


# --- lines


def brute_lines(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line_key(line)
            if i is not None and len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or gone.get(line_key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_line_dedup(spark, sample):
    same = "A line that many Documents share"
    rows = sample + [(20_000 + i, f"own {i}\n  {same.upper() if i % 2 else same}\t\nend") for i in range(50)]
    out = line_dedup(table(spark, rows)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, brute_lines(rows)))


def test_line_dedup_of_nothing(spark):
    assert line_dedup(table(spark, [])).count() == 0


def test_bloom_has_no_false_negatives():
    import numpy as np

    b, x = Bloom(1 << 16), np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    b.add(b.places(x[:1000]))
    assert b.has(b.places(x[:1000])).all() and b.has(b.places(x[1000:])).sum() < 100


# --- near duplicates


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows():
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(6):
        base = [r.choice(vocabulary) for _ in range(200)]
        for c in range(25):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((1000 * g + c * 7 + g, " ".join(w)))
    return rows


def test_near_duplicates(spark, sample):
    rows = [x for x in dict(sample).items() if x[0] is not None] + near_rows()
    rows = list({i: t for i, t in rows}.items())
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert out == brute_components(rows)
    assert len({v[1] for v in out.values()}) < len(out)


def test_pairs_at_the_threshold(spark):
    """300 pairs of similarity 0.85 are all linked, and 300 just under it are not."""
    rows = []
    for g in range(600):
        n, k = (37, 3) if g % 2 else (37, 4)
        w = [f"g{g}w{i}" for i in range(n + 4)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:-k] + [x + "x" for x in w[-k:]]))]
    out = minhash.near_duplicates(table(spark, rows)).filter("not kept").collect()
    assert {r.doc_id for r in out} == {2 * g + 1 for g in range(1, 600, 2)}


@pytest.mark.parametrize("percent,block", [(80, 1000), (85, 7)])
def test_open_pairs_lose_no_link(spark, percent, block):
    """Sets that share a passage, in families: all links between different roots come out, by blocks too."""
    import random

    r = random.Random(percent)
    passage, texts = [f"p{i}" for i in range(60)], []
    for _ in range(25):
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(r.randint(1, 6)):
            w = passage + own
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    schema = "id long, n long, tokens array<long>, " + ", ".join(f"{c} long" for c in minhash.BITMAP)
    sets = docs.mapInArrow(minhash._open_sets(5), schema)
    opened = docs.select("id", F.expr("id div 2").alias("root"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(minhash, "BLOCK", block)
        got = [tuple(x) for x in minhash.open_pairs(opened, sets, percent).collect()]
    memo = minhash.word_memo()
    s = [set(minhash.shingle_set(t, 5, memo).tolist()) for t in texts]
    links = {(a, b) for a, b in combinations(range(len(s)), 2) if a // 2 != b // 2 and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])}
    assert links <= set(got) and len(got) == len(set(got)) and 0 < len(links)
    assert len(got) < len(s) * len(s) / 8


def test_near_duplicates_edges(spark):
    long = " ".join(map(str, range(50)))
    rows = [(1, long), (1, long), (2, long.replace(" ", "\n")), (None, long), (3, None), (4, ""), (5, "few words"), (6, "FEW words"), (7, " ")]
    out = sorted(map(repr, map(tuple, minhash.near_duplicates(table(spark, rows)).collect())))
    want = [(1, 46, 1, True), (1, 46, 1, True), (2, 46, 1, False), (None, 46, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    assert out == sorted(map(repr, want))
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_signatures_within_the_threshold_share_a_key():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] ^= 1
    assert (minhash.index_keys(a) == minhash.index_keys(b)).any(axis=1).all()


def test_each_scheme_shares_a_key_within_its_distance():
    import numpy as np

    rng = np.random.default_rng(6)
    for how in minhash.SCHEMES.values():
        a = rng.integers(0, 1 << 16, (300, how.symbols)).astype("<u2")
        b = a.copy()
        for row in b:
            row[rng.choice(how.symbols, how.distance, replace=False)] ^= 1
        assert (minhash.index_keys(a, how) == minhash.index_keys(b, how)).any(axis=1).all()


def test_signatures_are_sized_for_the_percent(spark):
    from math import comb

    for percent in range(80, 101):
        how, p = minhash.scheme(percent), percent / 100
        assert sum(comb(how.symbols, k) * (1 - p) ** k * p ** (how.symbols - k) for k in range(how.distance + 1, how.symbols + 1)) < 1e-5
    with pytest.raises(ValueError):
        minhash.near_duplicates(table(spark, [(1, "a")]), percent=79)


def test_parity_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.integers(0, 30) :], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)]))
        differ = sum(bin(int(p) & (1 << 64) - 1).count("1") for p in (minhash.parity(x) ^ minhash.parity(y)).tolist())
        assert differ <= len(np.setxor1d(x, y))


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    out = dict(map(tuple, components(e).collect()))
    assert out == {i: 1 for i in range(2, 41)} | {101: 100}


# --- benchmark


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, whole, found = words(text), set(), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n and i is not None else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                whole |= set(range(k, k + n)) if n == 13 else set()
                found.add(str(i))
    return len(w), len(hit), len(whole), sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "Short item"), (3, "x"), (10, "alpha beta gamma delta"), (4, ""), (5, None), (None, "null id here"), (6, "a a a a a a a a a a a a a a a"), (2, "Short item"), (7, "Ünï cödé wörds hére")]


def test_decontaminate(spark, sample):
    long = ITEMS[0][1]
    rows = sample + [(30_000, f"before {long} after"), (30_001, long.upper().replace(" ", " -- ")), (30_002, "two three " + long[4:]), (30_003, "a short item and SHORT, item x"), (30_004, "a " * 40), (30_005, "alpha beta gamma"), (30_006, "x alpha beta gamma delta"), (30_000, "another text with this id"), (30_007, "Ünï cödé wörds hére")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").union(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text"))
    out = decon.decontaminate(table(spark, rows), bench).collect()
    items = [tuple(r) for r in bench.collect()]
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((i, *brute_hits(t, items))) for i, t in rows)


def test_long_items_and_common_words(spark):
    """Slices at both ends of an item, windows that overlap, and a one-word item that a text is full of; nothing broadcast or all."""
    import random

    r = random.Random(11)
    long = [r.choice(["p", "q", "r"]) + str(r.randrange(40)) for _ in range(700)]
    items = [("a", " ".join(long)), ("b", "w"), ("c", " ".join(long[100:160])), ("d", " ".join(long[300:313]))]
    cuts = [(0, 13), (0, 12), (5, 40), (687, 700), (690, 700), (100, 160), (299, 314), (301, 313)]
    rows = [(i, " ".join(["x", *long[a:b], "y"])) for i, (a, b) in enumerate(cuts)] + [(90, "w " * 5000), (91, " ".join(long)), (92, " ".join(long[:20] + ["z"] + long[20:33]))]
    for limits in ((decon.BROADCAST_ROWS, decon.BROADCAST_BYTES), (0, 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decon, "BROADCAST_ROWS", limits[0])
            m.setattr(decon, "BROADCAST_BYTES", limits[1])
            out = decon.decontaminate(table(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()
        assert sorted(map(repr, map(tuple, out))) == sorted(repr((i, *brute_hits(t, items))) for i, t in rows)


def test_decontaminate_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decon.decontaminate(table(spark, []), bench).count() == 0
    assert [tuple(r) for r in decon.decontaminate(table(spark, [(1, "some words")]), bench).collect()] == [(1, 2, 0, 0, [])]


# --- quality


def test_ledger_and_policies(spark):
    text = "\n".join(["the same line of eight words is here"] * 6)
    rows = [(1, text), (2, None), (3, ""), (4, " ".join(f"word{i}x" for i in range(60))), (None, "go go go go " * 10), (5, "$$$ " * 50)]
    book = quality_rules.ledger(table(spark, rows))
    got = {r.doc_id: r for r in book.collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].n_lines, got[1].n_dup_lines, got[1].word_chars) == (48, 48, 6, 5, 29 * 6)
    assert got[2].failed_bits == got[3].failed_bits == 1 and got[4].failed_bits == 0
    assert got[5].n_symbols == 150 and got[None].n_same_next == 39
    both = quality_rules.apply_policies(book, [quality_rules.BASE, quality_rules.DEFAULT])
    assert {r.doc_id for r in both.filter("kept_web_v1").collect()} == {4}
    assert {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(book, quality_rules.BASE).collect()} == {"few_words": (2, 2), "repeated_words": (3, 3)}
    assert quality_rules.ledger(table(spark, [])).count() == 0


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, hit = {}, set()
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for k in at for j in range(k, k + 8)}
    return len(hit)


def test_repeated_words(spark, sample):
    rows = [(i, t) for i, t in sample if t] + [(40_000 + n, " ".join("abcde"[:n] * 20)) for n in range(1, 5)]
    out = quality_rules.measure(table(spark, rows)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_repeat_words) for r in out))) == sorted(repr((i, brute_repeats(t))) for i, t in rows)


# --- secrets


def brute_spans(text):
    out = []
    for n, r in enumerate(secret_scan.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.shortest:
                out.append((m.start(r.group if r.ends else 0), n, m.end()))
    return sorted(out)


#: The expressions as one would write them, with the same spans.
PLAIN = {"jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "url_login": r"[A-Za-z][A-Za-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@"}


def test_anchored_rules_have_the_spans_of_plain_ones():
    import random

    r = random.Random(4)
    for rule in secret_scan.RULES:
        if rule.kind not in PLAIN:
            continue
        parts = {"jwt": ["eyJ", "ey", "aaaaaaaa", "b_-", ".", ".", " ", "eyJ01234567"], "url_login": ["http", "9", "+", "://", "://u:", "://u:pw@", ":", "@", "pw", "/", " ", "a.b-"]}[rule.kind]
        hits = 0
        for _ in range(40_000):
            text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
            want = [m.span() for m in re.finditer(PLAIN[rule.kind], text)]
            assert [m.span(1) for m in re.finditer(rule.pattern, text)] == want, text
            hits += len(want)
        assert hits > 300


def test_secrets_in_very_long_texts(spark):
    """Long runs of one kind of character, and very many matches, take time in proportion."""
    import time

    texts = ["a" * 400_000 + " x://", "a1" * 200_000 + "://u:p@h", "eyJ" * 100_000, "eyJ" * 50_000 + "." + "a" * 10 + "." + "b" * 10, "0123456789abcdef0123456789abcdef\n" * 40_000, "token=abcdef1 " * 20_000, "-----BEGIN " * 20_000, "x://" * 50_000, " " * 500_000]
    began = time.time()
    out = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.secret_scan(table(spark, list(enumerate(texts)))).collect()}
    assert time.time() - began < 60
    assert len(out[4]) == 40_000 and (0, 8, 400_007) in out[1]
    assert out == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_secrets(spark, sample):
    odd = [
        "é🎉 Password: 'abc123' token: token: abcdef secret==x api-key=1 APIKEY = \"abcdefgh\"", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 12, "AKIAshort",
        "0123456789abcdef" * 2, "deadbeef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "https://user:pass@host/x", "xoxb-1234567890", "Key tokenſ=abcdef",
    ]
    rows = sample + [(50_000 + i, t) for i, t in enumerate(odd)] + [(50_000, "nothing here")]
    out = secret_scan.secret_scan(table(spark, rows)).collect()
    got = [(r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in out]
    assert sorted(map(repr, got)) == sorted(repr((i, brute_spans(t))) for i, t in rows)
    assert secret_scan.secret_scan(table(spark, [])).count() == 0


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]+") is True and q("ab") is True
    assert q("AKIA[A-Z]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigrams(q("foo(bar|qux)?z")) == {"foo", "oob", "oba", "bar", "arz", "ooq", "oqu", "qux", "uxz", "ooz"}


def test_digest_of_no_spans(spark):
    empty = secret_scan.secret_scan(table(spark, [(1, "clean")])).select(F.sha2(secret_scan.written(F.col("spans")), 256)).first()[0]
    assert empty == hashlib.sha256(b"").hexdigest()
