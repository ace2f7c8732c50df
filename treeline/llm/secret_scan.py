"""Secret scans through a trigram inverted index (DataFrame functions only).

Each rule is a regular expression.  From its syntax tree follows a Boolean query
over trigrams that any match must satisfy; a rule that demands none scans fully.
The index lists, for each trigram that some query names, the documents that hold
it.  Intersecting the lists gives each document the rules it may match, and only
those expressions are run over its text.  Texts are indexed with A-Z in lower
case, so one index serves rules that ignore case and those that do not.

Matches are leftmost and do not overlap within a rule; then those whose secret
part is too short are dropped.  Positions are code points, the end exclusive.

Edge cases: a null or empty text has no spans.  Rows that share an id share their
candidate rules, and each is verified on its own text; a null id is treated like
any other.  Spans are ordered by start, then by the order of the rules, then by
end.  An empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialize
from .quality_rules import let


@dataclass(frozen=True)
class Rule:
    """``shortest``: code points that group ``group`` must have at least.

    ``ends``: the span is that of the group, which ends the match.
    """

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0
    ends: bool = False


#: Rules of the base, then those this operator adds (fixed values).  ``jwt`` and ``url_login`` are tried at the
#: start of a run of their characters alone, and pass over what comes before the secret: the same spans as those
#: of the plain expressions, without scanning the run again from each of its characters.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 1, 0, True),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^/\s:@]++:[^/\s:@]++@)", 1, 0, True),
)
RULES = BASE + ADDED

#: A query is True (nothing is demanded), a trigram, or ("and" | "or", queries).
MOST_STRINGS = 64
SPANS = "array<struct<start:int,kind:int,end:int>>"
RUN = 512


def _join(kind: str, parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not True or kind == "or"))
    if kind == "or" and True in parts:
        return True
    return (True if not parts else parts[0]) if len(parts) < 2 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    """What holds if one of the strings occurs."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(node) -> set[str] | None:
    """All strings a node can match, if they are few; in lower case."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).translate(str.maketrans(UPPER, LOWER))}
    if op is ops.IN:
        if any(o is not ops.LITERAL for o, _ in arg):
            return None
        return {chr(x).translate(str.maketrans(UPPER, LOWER)) for _, x in arg} if len(arg) <= 8 else None
    if op is ops.SUBPATTERN:
        return _all_strings(arg[3])
    if op is ops.BRANCH:
        each = [_all_strings(b) for b in arg[1]]
        return None if None in each else set().union(*each)
    if op is ops.MAX_REPEAT and arg[1] is not ops.MAXREPEAT and arg[1] <= 2:
        one = _all_strings(arg[2])
        return None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return None


def _all_strings(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        s = _strings(n)
        out = None if s is None else {a + b for a, b in product(out, s)}
        if out is None or len(out) > MOST_STRINGS:
            return None
    return out


def _query(nodes):
    """Runs of nodes with few strings are taken together; what lies between is looked into."""
    parts, run = [], {""}
    for node in nodes:
        s = _strings(node)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, s)}
            continue
        parts.append(_of_strings(run))
        run = {""} if s is None else s
        op, arg = node
        if s is not None:
            continue
        if op is ops.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is ops.BRANCH:
            parts.append(_join("or", [_query(b) for b in arg[1]]))
        elif op in (ops.MAX_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _join("and", [*parts, _of_strings(run)])


def trigram_query(pattern: str):
    return _query(parser.parse(pattern))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, has) for q in query[1]])


def postings(df: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, id): the inverted index of the given trigrams; grams by their position."""
    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    held = lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    # Outer, as the filter inferred from the plain form would compute the list a second time.
    return df.select(F.col(id_col).alias("id"), F.explode_outer(let(low, held)).alias("gram")).filter("gram IS NOT NULL")


def candidates(index: DataFrame, grams: list[str], queries: list) -> DataFrame:
    """(id, rules): the rules whose queries a document satisfies, as bits; documents without one are absent.

    The lists are intersected as one bit for each trigram, combined before they shuffle.
    """
    words = range(len(grams) // 63 + 1)
    bit = lambda w: F.coalesce(F.bit_or(F.when(F.expr(f"gram div 63 = {w}"), F.expr("shiftleft(1L, gram % 63)"))), F.lit(0).cast("long"))
    masks = index.groupBy("id").agg(*[bit(w).alias(f"w{w}") for w in words])
    has = lambda g: F.col(f"w{grams.index(g) // 63}").bitwiseAND(F.lit(1 << grams.index(g) % 63)) != 0
    bits = [F.when(_holds(q, has), F.lit(1 << i)).otherwise(0) for i, q in enumerate(queries) if q is not True]
    return masks.select("id", reduce(lambda a, b: a + b, bits).cast("long").alias("rules")).filter("rules <> 0")


def matches(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<start, kind, end>> of one rule: the text between matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = F.transform(F.split(text, rule.pattern), lambda x: F.length(x))
    rows = F.arrays_zip(F.transform(found, lambda x: F.length(x)).alias("n"), F.transform(part, lambda x: F.length(x)).alias("s"), F.slice(sizes, F.lit(1), F.size(found)).alias("gap"))
    return F.when(F.size(rows) > 0, let(rows, lambda r: _placed(r, rule, kind))).otherwise(F.array().cast(SPANS))


def _placed(rows: Column, rule: Rule, kind: int) -> Column:
    """Spans of matches (n, s, gap).  Lists grow within runs of ``RUN`` matches only, as each growth copies the list."""
    runs = F.transform(F.sequence(F.lit(0), _div(F.size(rows) - 1, RUN)), lambda k: F.slice(rows, k * RUN + 1, F.lit(RUN)))
    total = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + x["n"])
    end = lambda a, x: a["at"] + x["gap"] + x["n"]
    span = lambda a, x: F.struct((end(a, x) - (x["s"] if rule.ends else x["n"])).alias("start"), F.lit(kind).alias("kind"), end(a, x).alias("end"))
    step = lambda a, x: F.struct(end(a, x).alias("at"), F.when(x["s"] >= rule.shortest, F.array_append(a["out"], span(a, x))).otherwise(a["out"]).alias("out"))
    spans = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda a: a["out"])
    before = lambda totals, k: F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), lambda a, t: a + t)
    return let(runs, lambda r: let(F.transform(r, total), lambda t: F.flatten(F.transform(r, lambda run, k: spans(run, before(t, k))))))


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y)).cast("int")


def secret_scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array<struct<start, kind, end>>, ``kind`` a position in ``rules``."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(trigrams, queries)))
    index = materialize(postings(df, grams, id_col, text_col), "postings")
    able = candidates(index, grams, queries).withColumnRenamed("id", "id2")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = docs.join(able, F.col("id").eqNullSafe(F.col("id2")), "left")
    none = F.array().cast(SPANS)
    may = lambda i, q: F.lit(True) if q is True else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
    # A run of hex digits that is too short is passed over by the expression itself: runs are maximal either way.
    each = [F.when(may(i, q), matches(F.col("t"), _tight(r), i)).otherwise(none) for i, (r, q) in enumerate(zip(rules, queries, strict=True))]
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*each)).alias("spans"))


def _tight(rule: Rule) -> Rule:
    """The same matches, without those that are dropped, for a rule that is one repeated set."""
    tree = parser.parse(rule.pattern)
    if rule.group == 0 and len(tree) == 1 and tree[0][0] is ops.MAX_REPEAT and rule.pattern.endswith("]+") and rule.shortest > 1:
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.shortest},}}", 0, rule.shortest)
    return rule


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
