"""Token counts by prefix dynamic programming.

A word's exact token count is known at each of its byte prefixes after one pass
(``bpe.Vocabulary.extend``), and a text's at each word end by adding up.  That
answers counts, truncation and budget questions without encoding anything again:
only the one or two words around a cut are looked at.

Edge cases: a null or empty text has 0 bytes, 0 tokens and fits any limit.
Special strings inside texts are special tokens, as the library's default has
it.  Rows are taken one by one, so repeated rows and ties give repeated results,
an empty table an empty result, a null id stays null.  Only the id and text
columns are read; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, Memo, Vocabulary
from .common import small_batches, tidy

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


class TextCounts:
    """Counts at the prefixes of texts, for one vocabulary."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.memo = Memo(self._word)
        self._cut: tuple[str, list[int]] = ("", [0])

    def _word(self, word: str) -> array:
        """Token counts at the byte prefixes of a word, from 0 on."""
        counts = [0]
        self.voc.extend(word.encode(), [0], [-1], counts)
        return array("H" if len(counts) < 65536 else "I", counts)

    def _cuts(self, word: str) -> list[int]:
        """Token counts at the code point prefixes of a word; the last word's are kept."""
        if self._cut[0] != word:
            counts = self.memo[word]
            self._cut = (word, [counts[i] for i in accumulate((len(c.encode()) for c in word), initial=0)])
        return self._cut[1]

    def words(self, text: str) -> tuple[list[str], list[int]]:
        """The words and special strings of a text, and their token counts."""
        words: list[str] = []
        counts: list[int] = []
        for special, part in self.voc.sections(text):
            if special:
                words.append(part)
                counts.append(1)
            else:
                own = SPLIT.findall(part)
                words += own
                counts += [c[-1] for c in map(self.memo.__getitem__, own)]
        return words, counts

    def total(self, text: str) -> int:
        return sum(self.words(text)[1])

    def _within(self, words: list[str], ends: list[int], sums: list[int], text: str, w: int, k: int) -> int:
        """Tokens of ``text[:k]``, whose last character lies in word ``w``.

        As a rule the cut word's own prefix counts have the answer.  Where a cut
        changes how the end is split (white space joins what stands before it,
        a contraction or a special string is no longer one), the last three
        words are split again, and their counts are looked up.
        """
        start = ends[w - 1] if w else 0
        word = words[w]
        if k == ends[w] and w + 1 == len(words):
            return sums[w]
        plain = word not in self.voc.special and word[0] != "'" and not text[k - 1].isspace() and not (w and words[w - 1] in self.voc.special)
        if plain:
            return (sums[w - 1] if w else 0) + self._cuts(word)[k - start]
        first = max(0, w - 2)
        at = ends[first - 1] if first else 0
        return (sums[first - 1] if first else 0) + self.total(text[at:k])

    def prefix_counts(self, text: str) -> list[int]:
        """The exact token count of ``text[:k]`` for each k from 0 to the length."""
        words, counts = self.words(text)
        ends, sums = list(accumulate(map(len, words))), list(accumulate(counts))
        out = [0]
        for w in range(len(words)):
            out += [self._within(words, ends, sums, text, w, k) for k in range((ends[w - 1] if w else 0) + 1, ends[w] + 1)]
        return out

    def fit(self, text: str, limit: int) -> int:
        """The largest k with at most ``limit`` tokens in ``text[:k]``."""
        return self.count_and_fit(text, limit)[1]

    def count_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """The token count of a text, and what ``fit`` says."""
        words, counts = self.words(text)
        total = sum(counts)
        if total <= limit:
            return total, len(text)
        # Only the words up to the limit, and two more, can hold the cut.
        end, most = 0, 0
        while most <= limit:
            most += counts[end]
            end += 1
        words, counts = words[: end + 3], counts[: end + 3]
        sums = list(accumulate(counts))
        ends = list(accumulate(map(len, words)))
        # Whole words fit up to ``w``.  A cut can take at most two words with it.
        w = bisect_right(sums, limit)
        for x in range(min(w + 2, len(words) - 1), -1, -1):
            for k in range(ends[x], ends[x - 1] if x else 0, -1):
                if self._within(words, ends, sums, text, x, k) <= limit:
                    return total, k
        return total, 0


def prefix_table(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens): the exact token count at every prefix, in code points, from 0 to the length."""
    small_batches(df.sparkSession)

    def run(batches):
        counter = TextCounts(Vocabulary(vocab_path))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                counter.memo.room()
                rows.append(counter.prefix_counts(text or ""))
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "prefix_tokens"])

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(tidy(run), "id long, prefix_tokens array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars) for each row.

    ``fit_chars`` is the length, in code points, of the longest prefix of at most
    ``limit`` tokens.  One scan, no shuffle; a worker remembers a bounded number
    of distinct words.
    """
    small_batches(df.sparkSession)

    def run(batches):
        counter = TextCounts(Vocabulary(vocab_path))
        for b in batches:
            n_bytes, n_tokens, fits = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                counter.memo.room()
                n, fit = counter.count_and_fit(text, limit)
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
                fits.append(fit)
            yield pa.record_batch(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(tidy(run), f"id long, {SCHEMA}").withColumnRenamed("id", id_col)
