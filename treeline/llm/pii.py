"""Format-preserving pseudonyms by a keyed Feistel network (DataFrame functions only).

Card numbers (with a valid check digit), social security numbers, telephone
numbers, network addresses and calendar dates are validated, turned into a number
below the count of valid values of their format, permuted by a Feistel network on
the two digits of a mixed base, and written back in the same layout.  The local
part of an e-mail address is permuted character by character within letters and
digits.  A permutation has no collisions, and depends on the key and format
alone: equal values stay equal in all documents and different ones different.

What only looks like such a value but is not valid is left alone.

Edge cases: a null text stays null and has no finds; an empty one stays empty.
Rows are independent: repeated rows and ties give repeated results, an empty table
an empty result, a null id stays null.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

ROUNDS = 8
_ALONE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: A host up to the last label that starts with two letters, and of that one its letters alone.  Repeated
#: groups are possessive: others recurse once for each label, and a long host would overflow the stack.
_OTHER = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+"
_HOST = rf"[A-Za-z0-9-]++(?:{_OTHER}\.[A-Za-z]{{2}}[A-Za-z0-9-]*+(?={_OTHER}\.[A-Za-z]{{2}}))*+{_OTHER}\.[A-Za-z]{{2,}}"
#: Kind and expression, in the order in which they are tried (fixed values).
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@" + _HOST,
    "phone": _ALONE + r"(?:\+1[ .-]?)?\([2-9][0-9]{2}\)[ ]?[2-9][0-9]{2}[.-][0-9]{4}" + _END + "|" + _ALONE + r"(?:\+1[ .-]?)?[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4}" + _END,
    "ip": _ALONE + r"(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.[0-9])" + _END,
    "date": _ALONE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _END,
    "ssn": _ALONE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END,
    "card": _ALONE + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})" + _END,
}
ALL = "|".join(f"(?:{p})" for p in KINDS.values())
#: Layouts of dates, and the days of 400 years, after which the calendar repeats (fixed values).
DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")
FIRST_DAY, DAYS = "1800-01-01", 146097


def _sha(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def _number(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _div(x: Column, y) -> Column:
    return F.call_function("div", _long(x), _long(y))


def feistel(x: Column, a, b, key: str, kind) -> Column:
    """A keyed permutation of the numbers below a * b: the two digits of x in base b are shifted by turns."""
    a, b = _long(a), _long(b)

    def turn(s: Column, r: Column) -> Column:
        p = F.when(r % 2 == 0, (s["p"] + _number(_sha(key, kind, r, s["q"])) % a) % a).otherwise(s["p"])
        q = F.when(r % 2 == 1, (s["q"] + _number(_sha(key, kind, r, s["p"])) % b) % b).otherwise(s["q"])
        return F.struct(p.alias("p"), q.alias("q"))

    start = F.struct(_div(x, b).alias("p"), (_long(x) % b).alias("q"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["p"] * b + s["q"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _pad(n: Column, width) -> Column:
    return F.call_function("lpad", n.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _relayout(m: Column, chars: Column, which: str = "[0-9]") -> Column:
    """The characters of m in ``which`` are replaced by the given ones, in order; everything else stays."""
    return F.array_join(F.zip_with(F.split(m, which), chars, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _sub(s: Column, start, length) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substr(s, lit(start), lit(length))


def card(m: Column, key: str) -> Column:
    """The first digit stays, the check digit is made anew, what lies between is permuted."""

    def of(d: Column) -> Column:
        inner = F.length(d) - 2
        power = lambda n: F.get(F.array(*[F.lit(10**i) for i in range(10)]), n.cast("int"))
        low = power(_div(inner, 2))
        high = power(inner - _div(inner, 2))
        new = _pad(feistel(_sub(d, 2, inner), low, high, key, F.concat(F.lit("card"), F.length(d).cast("string"))), inner)
        check = lambda t: F.filter(F.array(*[F.lit(str(c)) for c in range(10)]), lambda c: F.call_function("luhn_check", F.concat(t, c)))
        return let(F.concat(_sub(d, 1, 1), new), lambda t: F.concat(t, F.get(check(t), F.lit(0))))

    return let(_digits(m), lambda d: F.when(F.call_function("luhn_check", d), _relayout(m, F.split(of(d), ""))).otherwise(m))


def phone(m: Column, key: str) -> Column:
    """Country code and the leading digits of area and exchange stay; the other eight are permuted."""

    def of(d: Column) -> Column:
        new = _pad(feistel(F.concat(_sub(d, -9, 2), _sub(d, -6, 2), _sub(d, -4, 4)), 10**4, 10**4, key, "phone"), 8)
        return let(new, lambda e: F.concat(_sub(d, 1, F.length(d) - 9), _sub(e, 1, 2), _sub(d, -7, 1), _sub(e, 3, 6)))

    return let(_digits(m), lambda d: _relayout(m, F.split(of(d), "")))


def ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99 and serials 0001-9999 are numbered without gaps."""
    area, group, serial = (_sub(m, s, n).cast("long") for s, n in ((1, 3), (5, 2), (8, 4)))
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    return let(feistel(index, 898 * 99, 9999, key, "ssn"), _ssn_text)


def _ssn_text(x: Column) -> Column:
    high = _div(x, 9999)
    area = _div(high, 99) + 1
    return F.concat(_pad(area + (area >= 666).cast("long"), 3), F.lit("-"), _pad(high % 99 + 1, 2), F.lit("-"), _pad(x % 9999 + 1, 4))


def ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    index = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    byte = lambda x, s: F.shiftright(x, s).bitwiseAND(255).cast("string")
    return let(feistel(index, 1 << 16, 1 << 16, key, "ip"), lambda x: F.concat_ws(".", *[byte(x, s) for s in (24, 16, 8, 0)]))


def date(m: Column, key: str) -> Column:
    """Valid dates of 1800 to 2199 are permuted among themselves."""
    first = F.lit(FIRST_DAY).cast("date")
    day, shapes = F.lit(None).cast("int"), tuple(zip(DATES, ("____-__-__", "__/__/____", "__.__.____"), strict=True))
    for layout, shape in shapes:
        day = F.when(m.like(shape), F.datediff(F.try_to_timestamp(m, F.lit(layout)).cast("date"), first)).otherwise(day)

    def written(new: Column) -> Column:
        out = m
        for layout, shape in shapes:
            out = F.when(m.like(shape), F.date_format(new, layout)).otherwise(out)
        return out

    new = lambda d: F.when((d >= 0) & (d < DAYS), F.date_add(first, feistel(d, 27, 5411, key, "date").cast("int")))
    return F.coalesce(let(let(day, new), written), m)


def email(m: Column, key: str) -> Column:
    """Letters and digits of the local part are shifted within their case or kind, half by half; the host stays.

    A round hashes the other half once, so the work is in proportion to the length.
    """
    which = "[A-Za-z0-9]"
    at = F.instr(m, "@")
    local = F.substr(m, F.lit(1), at - 1)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabet = lambda c: F.when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), upper).otherwise(digits)

    def shift(half: Column, other: Column, r: Column) -> Column:
        seed = _sha(key, "email", r, F.size(half), F.array_join(other, ""))
        moved = lambda c, a, i, h: F.substr(a, (F.position(c, a) - 1 + _number(_sha(h, i)) % F.length(a)).cast("int") % F.length(a) + 1, F.lit(1))
        return let(seed, lambda h: F.transform(half, lambda c, i: let(alphabet(c), lambda a: moved(c, a, i, h))))

    def turn(s: Column, r: Column) -> Column:
        p = F.when(r % 2 == 0, shift(s["p"], s["q"], r)).otherwise(s["p"])
        q = F.when(r % 2 == 1, shift(s["q"], s["p"], r)).otherwise(s["q"])
        return F.struct(p.alias("p"), q.alias("q"))

    cut = lambda c: _div(F.size(c), 2).cast("int")
    halves = lambda c: F.struct(F.slice(c, F.lit(1), cut(c)).alias("p"), F.slice(c, cut(c) + 1, F.size(c)).alias("q"))
    chars = F.filter(F.split(local, ""), lambda c: c.rlike(which))
    mixed = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves(c), turn, lambda s: F.concat(s["p"], s["q"]))
    return F.concat(_relayout(local, let(chars, mixed), which), F.substr(m, at, F.length(m)))


MAKERS = {"email": email, "phone": phone, "ip": ip, "date": date, "ssn": ssn, "card": card}


def _find(m: Column, key: str) -> Column:
    """The kind of a match, null if it is not valid, and what is written in its place."""
    is_kind = {k: m.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    kind, new = F.lit(None).cast("string"), m
    for k in reversed(KINDS):
        kind, new = F.when(is_kind[k], k).otherwise(kind), F.when(is_kind[k], MAKERS[k](m, key)).otherwise(new)
    return let(new, lambda n: let(kind, lambda k: F.struct(F.when(~k.isin("card", "date") | (n != m), k).alias("kind"), n.alias("new"))))


def pseudonymize(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, kinds): the text with pseudonyms, and the kind of each value replaced, in order.

    One scan, no shuffle.  Texts without a match are passed on as they are.  The
    key is part of the plan; keep plans and event logs where the key may be.
    """
    text = F.col("t")
    gaps = F.split(text, ALL)
    done = let(F.transform(F.regexp_extract_all(text, F.lit(ALL), F.lit(0)), lambda m: _find(m, key)), lambda f: _joined(gaps, f))
    same = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = own.select("id", F.when(text.rlike(ALL), done).otherwise(same).alias("x"))
    return out.select(F.col("id").alias(id_col), F.col("x.text").alias(text_col), F.col("x.kinds").alias("kinds"))


def _joined(gaps: Column, finds: Column) -> Column:
    parts = F.zip_with(gaps, finds, lambda g, f: F.concat(g, F.coalesce(f["new"], F.lit(""))))
    kinds = F.filter(F.transform(finds, lambda f: f["kind"]), lambda k: k.isNotNull())
    return F.struct(F.array_join(parts, "").alias("text"), kinds.alias("kinds"))
