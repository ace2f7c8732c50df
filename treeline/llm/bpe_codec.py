"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a batch that are not known yet are put into a trie and
walked depth-first; each node's last-token state is computed once for all words
below it (``bpe.trie_walk``).  Texts are then put together from their words'
tokens.  Decoding looks every token up in the vocabulary; bytes that are no
UTF-8 become replacement characters, as the library has it.

Edge cases: a null or empty text has no tokens and decodes to "".  Special
strings inside texts are special tokens.  Rows are independent: repeated rows
and ties give repeated results, an empty table an empty result, a null id stays
null.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import sys
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, Memo, Vocabulary, trie_walk
from .common import small_batches, tidy


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = ids[:]
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.memo = Memo(lambda w: next(iter(trie_walk(voc, [w])))[1].tobytes())

    def split(self, text: str) -> list[tuple[int | None, list[str]]]:
        """The words between special strings, and those strings' ids."""
        return [(self.voc.special[part], []) if special else (None, SPLIT.findall(part)) for special, part in self.voc.sections(text)]

    def learn(self, texts: list[list]) -> None:
        """Walk the trie of the distinct words of split texts that are not known."""
        self.memo.room()
        new: set[str] = set()
        for parts in texts:
            for _, words in parts:
                new.update(words)
        new.difference_update(self.memo)
        again = {w: self.memo.old[w] for w in new if w in self.memo.old}
        self.memo.update(again)
        for word, ids in trie_walk(self.voc, new.difference(again)):
            self.memo[word] = ids.tobytes()

    def encode(self, parts: list) -> array:
        out = array("I")
        for special, words in parts:
            if special is not None:
                out.append(special)
            else:
                out.frombytes(b"".join(map(self.memo.__getitem__, words)))
        return out

    def decode(self, ids: array) -> str:
        return b"".join(map(self.voc.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _pieces(texts: list[str], most: int = 1_000_000):
    """Runs of texts of at most ``most`` characters together, or one longer text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids, decoded), or with ``digests`` (id, n_tokens, ids_sha256, decoded_sha256); one scan, no shuffle."""
    small_batches(df.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        enc = Encoder(Vocabulary(vocab_path))
        for b in batches:
            ids, decoded = [], []
            for texts in _pieces([t or "" for t in b.column(1).to_pylist()]):
                split = [enc.split(t) for t in texts]
                enc.learn(split)
                for parts in split:
                    x = enc.encode(parts)
                    back = enc.decode(x)
                    ids.append((len(x), sha(little_endian(x))) if digests else x)
                    decoded.append(sha(back.encode()) if digests else back)
            if digests:
                cols = [pa.array([n for n, _ in ids], pa.int64()), pa.array([h for _, h in ids], pa.string()), pa.array(decoded, pa.string())]
                yield pa.record_batch([b.column(0), *cols], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.record_batch([b.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return own.mapInArrow(tidy(run), f"id long, {schema}").withColumnRenamed("id", id_col)
