"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window of an item occurs in a document only if all its shingles do, so one
shingle is the whole necessary prefix: the rarest.  One scan counts how often
each benchmark shingle occurs in the corpus; each window then keeps its rarest
shingle, and windows with one that never occurs are gone.  A second scan joins
the corpus with these shingles alone.  A match fixes where the item would lie in
the document; alignments that leave no whole window inside both texts are
dropped by length and position, and the rest are confirmed word by word against
the slice of the item around the shingle, of less than two windows.

Edge cases: a null or empty text has no words, is not hit and not contaminated;
items without words, or with a null id, are ignored; an item that is repeated is
listed once.  Rows that share an id are confirmed one by one on their own text; a
null id is treated like any other.  Empty tables give clean documents, or none.
Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, is_under, materialize
from .quality_rules import let

#: What separates words of lower-cased text, and of text as it is (fixed values).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 5
#: Benchmark shingles, of fixed-size columns alone, are broadcast up to so many rows of about 50 bytes.
BROADCAST_ROWS = 500_000
#: Slices of items are broadcast up to so many bytes, as summed before.
BROADCAST_BYTES = 32_000_000
#: Ids of documents with an alignment are broadcast up to so many rows of 8 bytes.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def shingles(of: Column, size: int) -> Column:
    """A 64-bit hash of the ``size`` words from each position on."""
    hashes = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))
    none = F.array().cast("array<bigint>")
    return let(F.transform(of, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= size, hashes(h)).otherwise(none))


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(uid, item, words, m, len, size): distinct items of ``m`` words, ``len`` words to a window, ``size`` to a shingle.

    An item shorter than a shingle is one shingle.
    """
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).filter("item is not null and size(words) > 0").distinct()
    m = F.size("words")
    return items.select(F.monotonically_increasing_id().alias("uid"), "item", "words", m.alias("m"), F.least(m, F.lit(window)).alias("len"), F.least(m, F.lit(SHINGLE)).alias("size"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(uid, m, len, size, token, pos): the shingles of each item, without its words."""
    parts = []
    for size in range(1, SHINGLE + 1):
        parts.append(items.filter(F.col("size") == size).select("uid", "m", "len", "size", F.posexplode(shingles(F.col("words"), size)).alias("pos", "token")))
    return reduce(DataFrame.union, parts)


def _corpus_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, n, pos, token) of all documents; only ids and numbers leave the scan."""
    arrays = lambda w: F.flatten(F.array(*[_placed(shingles(w, s)) for s in sizes])) if len(sizes) > 1 else shingles(w, sizes[0])
    # The words themselves stay inside this expression; only numbers are written to rows.  The outer
    # forms have no filter inferred from them, which would compute the arrays a second time.
    rows = docs.select("id", let(words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), arrays(w).alias("k"))).alias("s"))
    if len(sizes) == 1:
        return rows.select("id", "s.n", F.posexplode_outer("s.k").alias("pos", "token"))
    return rows.select("id", "s.n", F.explode_outer("s.k").alias("x")).select("id", "n", "x.pos", "x.token")


def _placed(tokens: Column) -> Column:
    return F.transform(tokens, lambda x, i: F.struct(i.alias("pos"), x.alias("token")))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_whole, items) for each row: words, words inside an occurrence of a
    window, those inside one of ``window`` words, and the sorted ids of the items that occur, as strings."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    items = materialize(benchmark_items(benchmark, item_col, item_text_col, window), "items")
    marks = materialize(item_shingles(items), "item-shingles")
    sizes = sorted(r["size"] for r in marks.select("size").distinct().collect()) or [SHINGLE]  # at most SHINGLE rows
    small = F.broadcast if is_under(marks, BROADCAST_ROWS) else (lambda x: x)

    # Shingles of different sizes have different hashes, so the hash alone is the join key.
    tokens = marks.select("token").distinct()
    counts = materialize(_corpus_shingles(docs, sizes).select("token").join(small(tokens), "token").groupBy("token").agg(F.count(F.lit(1)).alias("found")), "shingle-counts")

    # Each window: the shingles from ``pos`` to ``pos + len - size`` of its item; keep the rarest.
    inside = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (F.col("len") - F.col("size"))), F.least(F.col("pos"), F.col("m") - F.col("len"))))
    rated = marks.join(counts, "token", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    choice = F.min(F.struct("found", "pos", "token")).alias("x")
    rarest = rated.select("uid", "m", "len", "size", "found", "pos", "token", inside.alias("start")).groupBy("uid", "m", "len", "size", "start").agg(choice)
    prefix = rarest.filter("x.found > 0").select("uid", "m", "len", "size", F.col("x.pos").alias("at"), F.col("x.token").alias("token")).distinct()
    # All windows that hold the shingle lie in this slice of the item, at most 2 * len - size words.
    first = F.greatest(F.lit(0), F.col("at") + F.col("size") - F.col("len"))
    prefix = prefix.select("uid", "at", "token", "len", first.alias("first"), (F.least("m", F.col("at") + F.col("len")) - first).alias("span"))
    prefix = materialize(prefix, "prefixes")

    near = _corpus_shingles(docs, sizes).join(small(prefix), "token")
    begin = F.col("pos") - F.col("at") + F.col("first")
    room = F.least(F.col("n"), begin + F.col("span")) - F.greatest(F.lit(0), begin)
    # Only numbers are listed by document and slice; the words of a slice join once for each list.
    placed = near.filter(room >= F.col("len")).groupBy("id", "uid", "at").agg(F.collect_set(begin).alias("begins"))
    slices = prefix.join(items.select("uid", "item", "words"), "uid").select("uid", "at", F.col("item").cast("string").alias("item"), "len", F.slice("words", F.col("first") + 1, F.col("span")).alias("words")).distinct()
    slices = materialize(slices, "slices")
    octets = F.octet_length("item") + F.aggregate("words", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    few = (slices.agg(F.sum(octets + 80)).first()[0] or 0) <= BROADCAST_BYTES
    aligned = materialize(placed, "alignments").join(F.broadcast(slices) if few else slices, ["uid", "at"])
    per_doc = materialize(aligned.groupBy("id").agg(F.collect_list(F.struct("item", "words", "len", "begins")).alias("aligned")), "alignments-by-document")
    drop(items, marks, counts, prefix)

    # Only texts with an alignment are read again whole; rows that share an id are told apart by their text.
    per_doc = per_doc.withColumnRenamed("id", "id2")
    same = F.col("id").eqNullSafe(F.col("id2"))
    ids = per_doc.select("id2")
    texts = docs.join(F.broadcast(ids) if is_under(ids, BROADCAST_IDS) else ids, same, "left_semi")
    found = let(words(F.col("t")), lambda w: F.transform("aligned", lambda a: _confirm(w, a)))
    found = texts.join(per_doc, same).select("id", F.xxhash64("t").alias("h"), F.filter(found, lambda f: F.size(f["at"]) > 0).alias("found"))
    n_hit = lambda of: F.size(F.array_distinct(F.flatten(F.transform(of, lambda f: f["at"])))).cast("long")
    whole = F.filter("found", lambda f: f["len"] == window)
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["item"])))
    hits = found.select(F.col("id").alias("id2"), F.col("h").alias("h2"), n_hit("found").alias("n_hit"), n_hit(whole).alias("n_whole"), names.alias("items")).dropDuplicates(["id2", "h2"])
    plain = F.array_remove(F.split(F.coalesce(F.col("t"), F.lit("")), GAPS_ANY_CASE), "")
    every = docs.select("id", F.xxhash64("t").alias("h"), F.size(plain).cast("long").alias("n_words"))
    out = every.join(hits, same & (F.col("h") == F.col("h2")), "left")
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "n_words", zero("n_hit"), zero("n_whole"), F.coalesce("items", none).alias("items"))


def _confirm(w: Column, a: Column) -> Column:
    """The item, and the document's positions inside windows that are equal word for word.

    ``begins``: where the first word of the slice would lie in the document.
    """

    def at(begin: Column) -> Column:
        first = F.greatest(F.lit(0), -begin)
        last = F.least(F.size(a["words"]), F.size(w) - begin) - a["len"]
        starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        equal = F.filter(starts, lambda s: F.slice(w, s + begin + 1, a["len"]) == F.slice(a["words"], s + 1, a["len"]))
        return F.flatten(F.transform(equal, lambda s: F.sequence(s + begin, s + begin + a["len"] - 1)))

    found = F.array_distinct(F.flatten(F.transform(a["begins"], at)))
    return F.struct(a["item"].alias("item"), a["len"].alias("len"), found.alias("at"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
