"""Column expressions that write attributes the way the command line shows them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(n: Column, value: int) -> Column:
    return n.bitwiseAND(F.lit(value)) != 0


def mode_string(mode: Column) -> Column:
    """rwxrwxrwx; the sticky bit (octal 1000) shows as t or T in the last place."""
    parts = [F.when(bit(mode, 1 << (8 - i)), "rwx"[i % 3]).otherwise("-") for i in range(8)]
    last = F.when(bit(mode, 512), F.when(bit(mode, 1), "t").otherwise("T")).when(bit(mode, 1), "x").otherwise("-")
    return F.concat(*parts, last)


def human_size(size: Column) -> Column:
    """KB at least, two digits of a rounded fraction without trailing zeros."""
    whole = F.greatest(F.lit(0).cast("long"), size)
    out = F.lit(None).cast("string")
    units = ("KB", "MB", "GB", "TB", "PB")
    for i in reversed(range(len(units))):
        n = F.shiftright(whole, 10 * i)
        frac = F.shiftright((n.bitwiseAND(1023)) * 100 + 512, 10)
        carry = (frac >= 100).cast("long")
        frac = frac - 100 * carry
        digits = F.when(frac == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(frac.cast("string"), 2, "0"), F.lit("0"))))
        text = F.concat((F.shiftright(n, 10) + carry).cast("string"), digits, F.lit(" " + units[i]))
        out = text if i == len(units) - 1 else F.when(n < 1 << 20, text).otherwise(out)
    return out



def iso_micros(us: Column) -> Column:
    """UTC, six digits of a second, whatever the session's time zone."""
    rest = F.pmod(us, F.lit(86400000000))
    day = F.call_function("div", us - rest, F.lit(86400000000))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    part = lambda unit, size: F.lpad((F.call_function("div", rest, F.lit(unit)) % size).cast("string"), 2, "0")
    return F.concat(date.cast("string"), F.lit("T"), part(3600000000, 24), F.lit(":"), part(60000000, 60), F.lit(":"), part(1000000, 60), F.lit("."), F.lpad((rest % 1000000).cast("string"), 6, "0"), F.lit("Z"))


def parse_iso(text: Column) -> Column:
    """Microseconds of what ``iso_micros`` writes; null for any other form and for days that no month has."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z"
    stamp = F.translate(F.substring(text, 1, 26), "T", " ").try_cast("timestamp_ntz")
    return F.when(text.rlike(form), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp))


def readable_bytes(size: Column) -> Column:
    """Two digits of a fraction, ties to even, in the largest unit that the size is over; the space is the web page's entity."""
    out = F.concat(size.cast("string"), F.lit(".00&nbsp;bytes"))
    for bits, unit in ((20, "MB"), (30, "GB"), (40, "TB"), (50, "PB")):
        mask = (1 << bits) - 1
        cents = size.bitwiseAND(F.lit(mask)) * 100
        whole, rest = F.shiftright(cents, bits), cents.bitwiseAND(F.lit(mask))
        half = F.lit(1 << (bits - 1))
        up = (rest > half) | ((rest == half) & (whole % 2 == 1))
        n = whole + up.cast("long")
        text = F.concat((F.shiftright(size, bits) + (n == 100).cast("long")).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(f"&nbsp;{unit}"))
        out = F.when(size > F.lit(1 << bits), text).otherwise(out)
    return out


def override(base: Column, later: Column) -> Column:
    """Union of two maps; of a key in both, the later value."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(later, k)), later)


def listed_object(xml: Column) -> Column:
    """Key and size of an object in a bucket listing of one entry; null fields for what is missing."""
    return F.from_xml(xml, "Contents struct<Key: string, Size: long>")["Contents"]


def ls_minute(us: Column) -> Column:
    return F.replace(F.substring(iso_micros(us), 1, 16), F.lit("T"), F.lit(" "))


def basename(path: Column) -> Column:
    return F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_extract(path, "([^/]+)/*$", 1))


def normalize_path(path: Column) -> Column:
    """Without empty and ``.`` parts; ``..`` takes its parent away, and nothing above the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).otherwise(F.array_append(a, x)))
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def glob_regex(pattern: str) -> str:
    """A path pattern with ``* ? []`` as an anchored expression; none of them matches a slash or a leading dot."""
    out, i, start = "", 0, True
    while i < len(pattern):
        c = pattern[i]
        dot = r"(?!\.)" if start else ""
        if c == "*":
            out += dot + "[^/]*"
        elif c == "?":
            out += dot + "[^/]"
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j].replace("\\", r"\\")
            out += f"{dot}(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]"
            i = j
        else:
            out += re.escape(c)
        start = c == "/"
        i += 1
    return f"^{out}$"


def stat_format(fmt: str, col=F.col) -> Column:
    """The columns type, size, name, num_replicas, mtime (microseconds) by a printf-like format."""
    size = F.greatest(F.lit(0).cast("long"), col("size")).cast("string")
    is_dir = col("type") == "dir"
    known = {
        "b": size, "F": F.when(is_dir, "directory").otherwise("regular file"), "n": col("name"), "o": F.lit("67108864"),
        "r": F.when(is_dir, "0").otherwise(F.greatest(F.lit(1), col("num_replicas")).cast("string")),
        "y": F.concat(ls_minute(col("mtime")), F.lit(" ")), "Y": F.call_function("div", col("mtime"), F.lit(1000000)).cast("string"),
    }
    parts, i, fmt = [], 0, fmt or "%y"
    while i < len(fmt):
        if fmt[i] != "%":
            parts.append(F.lit(fmt[i]))
        elif i + 1 < len(fmt):
            i += 1
            parts.append(known.get(fmt[i], F.lit(fmt[i])))
        i += 1
    return F.concat(*parts) if parts else F.lit("")


def chmod(mode: Column, is_dir: Column, change: str) -> Column:
    """A symbolic (``u+rw,go-w,a=rX``) or octal change of permissions."""
    if re.fullmatch("[0-7]+", change):
        return F.lit(int(change, 8)).cast("long")
    for clause in change.split(","):
        m = re.fullmatch("([ugoa]*)([+=-])([rwxXt]*)", clause)
        if not m:
            raise ValueError(f"not a mode: {clause}")
        who, op, what = m[1] or "a", m[2], m[3]
        who = "ugo" if "a" in who else who
        shifts = [{"u": 6, "g": 3, "o": 0}[w] for w in who]
        plain = sum({"r": 4, "w": 2, "x": 1}[c] for c in set(what) & set("rwx"))
        bits = F.lit(sum(plain << s for s in shifts) + 512 * ("t" in what)).cast("long")
        if "X" in what:
            extra = F.when(is_dir | bit(mode, 73), F.lit(sum(1 << s for s in shifts))).otherwise(0).cast("long")
            bits = bits.bitwiseOR(extra)
        clear = F.lit(~sum(7 << s for s in shifts))
        mode = mode.bitwiseOR(bits) if op == "+" else mode.bitwiseAND(F.bitwise_not(bits)) if op == "-" else mode.bitwiseAND(clear).bitwiseOR(bits)
    return mode
