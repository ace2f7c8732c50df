import hashlib
import random
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treeline.llm.bpe import Memo, Vocabulary, trie_walk
from treeline.llm.bpe_codec import Encoder, encode_decode, little_endian
from treeline.llm.token_counts import TextCounts, prefix_table, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "ab  \n\t'srtvmld<|endoftext|>é½²\x1c\x1f\x85​᠎　ⅷ中!?_-0123\x00́🎉"
VOC, LIB = Vocabulary(PATH), Tokenizer.from_file(PATH)


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=ODD, max_size=40)))
def test_encodes_as_the_library(text):
    e = Encoder(VOC)
    parts = e.split(text)
    e.learn([parts])
    assert e.encode(parts).tolist() == ids_of(text)
    assert e.decode(e.encode(parts)) == LIB.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ODD, max_size=20), st.integers(0, 6))
def test_every_prefix_has_its_exact_count(text, limit):
    text += random.Random(len(text)).choice(["", "<|endoftext|>", " 's"])
    want = [len(ids_of(text[:k])) for k in range(len(text) + 1)]
    c = TextCounts(VOC)
    assert c.prefix_counts(text) == want
    assert c.fit(text, limit) == max(k for k, n in enumerate(want) if n <= limit)


def test_trie_walk_shares_prefixes():
    words = ["the", "then", "there", "theres", "a", "", "there"]
    assert {w: x.tolist() for w, x in trie_walk(VOC, words) if w} == {w: ids_of(w) for w in set(words) if w}


def test_memo_is_bounded_and_right():
    m = Memo(lambda w: w * 2, most=3)
    for w in "abcdefabc" * 5:
        m.room()
        assert m[w] == w * 2
        assert len(m) <= 4 and len(m.old) <= 4
    assert m["x" * 1000] == "x" * 2000 and "x" * 1000 not in m


ROWS = [(1, "The cat sat.\nOn the <|endoftext|> mat's end"), (1, "The cat sat."), (2, None), (3, ""), (None, "hello"), (4, "naïve 中文 🎉 " * 3000), (5, "x" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "n") for i, t in ROWS], "doc_id long, text string, n_tokens int, id string")


def test_counts(docs):
    out = token_counts(docs, PATH).collect()
    want = [(i, len((t or "").encode()), len(ids_of(t or "")), len(ids_of(t or "")) > 512) for i, t in ROWS]
    assert sorted(map(repr, (tuple(r)[:4] for r in out))) == sorted(map(repr, want))
    assert all(r.fit_chars < r.n_bytes for r in out if r.over_limit)


def test_codec(docs):
    out = encode_decode(docs, PATH, digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids_of(t or "")), sha(little_endian(array("I", ids_of(t or "")))), sha((t or "").encode())) for i, t in ROWS]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    plain = encode_decode(docs, PATH).collect()
    assert sorted((len(r.ids), r.decoded) for r in plain) == sorted((len(ids_of(t or "")), t or "") for _, t in ROWS)


def test_prefix_table(docs):
    out = {r.doc_id: r.prefix_tokens for r in prefix_table(docs.filter("doc_id = 3 OR length(text) < 20"), PATH).collect()}
    assert out[3] == [0] and out[None] == [len(ids_of("hello"[:k])) for k in range(6)]


def test_empty_table(docs):
    none = docs.filter("false")
    assert token_counts(none, PATH).count() == encode_decode(none, PATH).count() == encode_decode(none, PATH, digests=True).count() == 0
