"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once.  The ledger keeps, for each document, what was
measured and one bit for each rule that failed.  Policies are named, versioned
sets of rules; applying one, or asking what a rule alone removes, reads the bits
and never the texts again.

Edge cases: a null or empty text has no words and fails ``few_words``.  Rows are
independent: repeated rows and ties give repeated results, an empty table an
empty ledger, a null id stays null.  Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, and the symbols that are counted (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
OTHERS = "0123456789!\"'()+,-./:;=?@[\\]^_`{}~"
WINDOW = 8

#: Rule name, and when it fails, as SQL over the measurements; the bit is the position.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("symbols", "4 * n_symbols > n_words"),
    ("word_length", "n_words > 0 AND (2 * word_chars < 3 * n_words OR word_chars > 40 * n_words)"),
    ("few_letters", "10 * n_letters < 3 * word_chars"),
    ("stutter", "100 * n_same_next > 30 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is rejected if any rule of ``rules`` failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
DEFAULT = Policy("web", 1, tuple(BIT))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for each row and not once for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(grams: Column) -> Column:
    """Positions that lie in a window found more than once; ``grams``: a hash of each window."""
    twin = lambda s, i, k: F.coalesce(F.get(s, i + k)["g"] == F.get(s, i)["g"], F.lit(False))
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: twin(s, i, -1) | twin(s, i, 1))
    starts = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    total = let(ordered, lambda s: let(starts(s), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x)))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(total)


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur more than once, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    at = lambda h: F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
    grams = lambda h: F.transform(at(h), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) > WINDOW, let(grams(h), _covered)).otherwise(0))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements); one scan, no shuffle, no text leaves the row."""
    text = F.coalesce(F.col("t"), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    same = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), same(w).alias("s")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    n = lambda c: c.cast("long")
    return own.select("id", text.alias("t"), of_words.alias("w"), of_lines.alias("l")).select(
        F.col("id").alias(id_col),
        n(F.col("w.n")).alias("n_words"),
        n(F.length("t") - _without(F.col("t"), SPACE)).alias("word_chars"),
        n(_without(F.col("t"), SYMBOLS)).alias("n_symbols"),
        n(F.length(F.translate(F.col("t"), SPACE + SYMBOLS + OTHERS, ""))).alias("n_letters"),
        n(F.col("l.n")).alias("n_lines"),
        n(F.col("l.d")).alias("n_dup_lines"),
        n(F.col("w.r")).alias("n_repeat_words"),
        n(F.col("w.s")).alias("n_same_next"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed_bits): bit i of ``failed_bits`` is set if rule i failed."""
    bits = " + ".join(f"CASE WHEN {when} THEN {BIT[name]}L ELSE 0L END" for name, when in RULES)
    return measure(df, id_col, text_col).withColumn("failed_bits", F.expr(bits))


def failed(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policies(book: DataFrame, policies: list[Policy]) -> DataFrame:
    """The ledger with a column ``kept_<name>_v<version>`` for each policy."""
    return book.withColumns({f"kept_{p.name}_v{p.version}": ~failed(p) for p in policies})


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only): rows a rule rejects, and rows the policy would keep without it.

    Rows are first counted by their bits, so at most 2^rules rows are shuffled from each task.
    """
    mine = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    counts = book.groupBy(mine.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    return (
        counts.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
