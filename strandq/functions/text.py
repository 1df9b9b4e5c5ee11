"""Words, numbers and paths in text as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def chomp(s: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(s, r"[ \t\n\r\x0B\f]+$", "")


def words(s: Column, gap: str = r"[ \t\n\r]+") -> Column:
    """Non-empty words between runs of a gap pattern."""
    return F.filter(F.split(s, gap), lambda x: x != "")


def ident(line: Column) -> Column:
    """The first visible run of a header line (without its > or @)."""
    return F.regexp_extract(line, r"^[ \t]*([^ \t]*)", 1)


def flags(line: Column) -> Column:
    """What follows the name: verbatim behind a tab, else trimmed."""
    tab = F.regexp_extract(line, r"^[ ]*[^ \t]+\t(.*)$", 1)
    rest = F.trim(F.regexp_extract(line, r"^[ \t]*[^ \t]* +(.*)$", 1))
    return F.when(line.rlike(r"^[ ]*[^ \t]+\t"), tab).otherwise(rest)


def to_bool(s: Column) -> Column:
    """y, Y, t, T, 1, yes and true in any case are true; all else is false."""
    return F.coalesce(F.lower(s).isin("y", "t", "1", "yes", "true"), F.lit(False))


def leading_integer(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")


_INTEGER = r"^([+-]?)([0-9a-fA-F]+?)(?:([kKmMgGtTpPeE])(i?)|([bBoOdDhH])?)$"


def key_value(line: Column) -> Column:
    """key, value around the first run of ':' and '='; the key may hold spaces, the value may be empty.  Null for a line without
    a key or such a run.  Comments begin with ! or # at the start or behind white space."""
    body = F.regexp_replace(line, r"(?s)(?:^|\s+)[!#].*$", "")
    pattern = r"(?s)^\s*([^\s:=][^:=]*?)\s*[:=]+\s*(.*?)\s*$"
    return F.when(body.rlike(pattern), F.struct(F.regexp_extract(body, pattern, 1).alias("key"), F.regexp_extract(body, pattern, 2).alias("value")))


def decode_integer(s: Column) -> Column:
    """Sign, digits, and a base suffix (b, o, d, h) or a scale (k, m, g, t, p, e, with i for powers of 1024); null if it isn't one."""
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    dec = F.regexp_extract(s, r"^[+-]?([0-9]+)[dD]?i?$", 1)
    scale = F.lower(F.regexp_extract(s, r"^[+-]?[0-9]+([kKmMgGtTpPeE])i?$", 1))
    scaled = F.regexp_extract(s, r"^[+-]?([0-9]+)[kKmMgGtTpPeE]i?$", 1)
    power = F.coalesce(*[F.when(scale == c, i) for i, c in enumerate("kmgtpe", 1)])
    unit = F.when(s.rlike("i$"), F.pow(F.lit(1024), power)).otherwise(F.pow(F.lit(1000), power)).cast("long")
    base = lambda digits, suffix, b: F.when(s.rlike(f"^[+-]?[{digits}]+[{suffix}]$"), F.conv(F.regexp_extract(s, f"^[+-]?([{digits}]+)[{suffix}]$", 1), b, 10).cast("long"))
    return sign * F.coalesce(base("0-9a-fA-F", "hH", 16), base("01", "bB", 2), base("0-7", "oO", 8), F.when(scaled != "", scaled.cast("long") * unit), F.when(dec != "", dec.try_cast("long")))


def decode_ranges(s: Column) -> Column:
    """Array of lo, hi of '1-5,7,9/12,20-': an open end is the largest 64-bit number."""
    one = r"^([0-9]+)(?:([-/])([0-9]*))?$"
    part = lambda x, g: F.regexp_extract(x, one, g)
    return F.transform(F.filter(F.split(s, ","), lambda x: x.rlike(one)), lambda x: F.struct(part(x, 1).cast("long").alias("lo"), F.when(part(x, 2) == "", part(x, 1).cast("long")).when(part(x, 3) == "", F.lit(2**63 - 1)).otherwise(part(x, 3).try_cast("long")).alias("hi")))


def range_numbers(s: Column) -> Column:
    """The distinct numbers of '1-5,7,9/12', for ranges with two ends."""
    one = F.filter(decode_ranges(s), lambda r: (r["lo"] <= r["hi"]) & (r["hi"] < F.lit(2**63 - 1)))
    return F.array_distinct(F.flatten(F.transform(one, lambda r: F.sequence(r["lo"], r["hi"]))))


def si(x: Column) -> Column:
    """A number with its unit letter: divided by 1000 while it exceeds 9999."""
    out = F.concat(F.floor(x / 1000**6).cast("string"), F.lit("E"))
    for i, c in reversed(list(enumerate(["", "k", "M", "G", "T", "P"]))):
        out = F.when(F.floor(x / 1000**i) <= 9999, F.concat(F.floor(x / 1000**i).cast("string"), F.lit(c))).otherwise(out)
    return out


def visible(s: Column) -> Column:
    """Control characters by name in angle brackets."""
    names = "NUL SOH STX ETX EOT ENQ ACK BEL BS TAB LF VT FF CR SO SI DLE DC1 DC2 DC3 DC4 NAK SYN ETB CAN EM SUB ESC FS GS RS US".split()
    for i, n in [*enumerate(names), (127, "DEL")]:
        s = F.replace(s, F.lit(chr(i)), F.lit(f"<{n}>"))
    return s


def basename(s: Column) -> Column:
    return F.substring_index(s, "/", -1)


def without_suffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), s.substr(F.lit(1), F.length(s) - len(suffix))).otherwise(s)


#: Where the hash of words starts; the factors of a word and the turn between them; what the state is turned
#: by, multiplied with and added to; the factors and shifts at the end.
HASH_SEED = 0xB0F57EE3
HASH_WORD, HASH_WORD_TURN = (0xCC9E2D51, 0x1B873593), 15
HASH_TURN, HASH_FACTOR, HASH_ADDED = 13, 5, 0xE6546B64
HASH_END, HASH_SHIFTS = (0x85EBCA6B, 0xC2B2AE35), (16, 13, 16)


def word_hash(words_: Column) -> Column:
    """A 32-bit hash of an array of unsigned 32-bit numbers (as long): products are taken modulo 2**32 in two halves."""
    low = lambda x: x.bitwiseAND(0xFFFFFFFF)
    named = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  so that x is written, and evaluated, once
    times = lambda x, c: named(x, lambda a: low(a.bitwiseAND(0xFFFF) * c + low(F.shiftright(a, 16) * (c & 0xFFFF)) * 65536))
    rotate = lambda x, r: named(x, lambda a: low(F.shiftleft(a, r)).bitwiseOR(F.shiftright(a, 32 - r)))
    folded = lambda x, r: named(x, lambda a: a.bitwiseXOR(F.shiftright(a, r)))

    def step(h, w):
        k = times(rotate(times(w, HASH_WORD[0]), HASH_WORD_TURN), HASH_WORD[1])
        return low(times(rotate(h.bitwiseXOR(k), HASH_TURN), HASH_FACTOR) + HASH_ADDED)

    def finish(h):
        h = folded(h.bitwiseXOR(F.size(words_).cast("long")), HASH_SHIFTS[0])
        for factor, shift in zip(HASH_END, HASH_SHIFTS[1:], strict=True):
            h = folded(times(h, factor), shift)
        return h

    return F.aggregate(words_, F.lit(HASH_SEED), step, finish)


def trimmed(s: Column) -> Column:
    """Without spaces, and nothing but spaces, at either end."""
    return F.trim(s)


#: Classes of one character.
CLASSES = {"space": r"[ \t\n\r\x0B\f]", "visible": r"[!-~]", "letter": r"[A-Za-z]", "bin": r"[01]", "oct": r"[0-7]", "dec": r"[0-9]", "hex": r"[0-9A-Fa-f]", "comment": r"[!#]", "delimiter": r"[:=]"}


def of_class(s: Column, name: str) -> Column:
    """Whether s is one or more characters of a class; empty texts aren't."""
    return s.rlike(rf"\A{CLASSES[name]}+\z")


def is_decimal(s: Column) -> Column:
    """Digits and dots in any mixture, without a sign."""
    return s.rlike(r"\A[0-9.]+\z")


def leading_number(s: Column) -> Column:
    """The floating-point number that a text begins with, behind white space; null without one."""
    return F.regexp_extract(s, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def behind_number(s: Column) -> Column:
    """What follows the leading integer."""
    return F.regexp_replace(s, r"^\s*[+-]?[0-9]+", "")


def in_base(x: Column, base: int, width: int = 0) -> Column:
    """A non-negative number in base 2, 8, 10 or 16, lower-case, filled with zeros up to width."""
    digits = F.lower(F.conv(x.cast("string"), 10, base))
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def megabytes(bits: Column) -> Column:
    """Bits as MB of 2**20 bytes; bits short of a byte don't count."""
    return F.floor(bits / 8) / float(1 << 20)


def percent_decoded(s: Column) -> Column:
    """%XX escapes decoded; a plus sign stays."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def hex_dump(data: Column, wide: int = 16) -> Column:
    """Lines of an address, the bytes as hexadecimal pairs and as visible characters (others as dots), `wide` bytes each."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(wide))).otherwise(F.array().cast("array<int>"))
    part = lambda at: F.substr(data, at + 1, F.lit(wide))
    pairs = lambda at: F.rtrim(F.regexp_replace(F.lower(F.hex(part(at))), "(..)", "$1 "))
    shown = lambda at: F.regexp_replace(F.decode(part(at), "ISO-8859-1"), r"[^ -~]", ".")
    return F.transform(starts, lambda at: F.concat_ws("  ", F.lpad(F.lower(F.hex(at)), 8, "0"), pairs(at), shown(at)))


def joined_path(*parts: Column) -> Column:
    """Parts of a path between single slashes; null and empty ones are left out."""
    return F.regexp_replace(F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in parts)), "//+", "/")


def java_pattern(pattern: str) -> str:
    """A pattern of the dialect in which groups don't capture unless they begin with {c}, and match any of their prefixes if
    they begin with {p}, in Spark's own: (x) is (?:x), ({c}x) is (x), ({p}xyz) is (?:x(?:y(?:z)?)?)?, {,b} is {0,b}; ^ and $
    stand for themselves, and a dot for any character.  Matches begin at the start of a text."""
    atom = r"\\.|\[(?:\[:[a-z]+:\]|\\.|[^\]\\])*\]|[^\\\[]"
    out, ends = [], []
    items = re.findall(rf"\((?:\{{[cp]\}})?|\)|\{{[0-9]*,?[0-9]*\}}|{atom}", pattern, re.DOTALL)
    for x in items:
        if x in ("(", "({c}", "({p}"):
            out.append({"(": "(?:", "({c}": "(", "({p}": "(?:"}[x])
            ends.append(["p", 0] if x == "({p}" else ["", 0])
        elif x == ")":
            kind, n = ends.pop()
            out.append(")?" * n + (")" if kind != "p" else ")"))
        elif re.fullmatch(r"\{,[0-9]+\}", x):
            out.append("{0" + x[1:])
        elif x[0] == "{" or x in "*+?|":
            out.append(x)
        else:
            x = {"^": r"\^", "$": r"\$", ".": r"(?s:.)"}.get(x, x)
            x = re.sub(r"\[:([a-z]+):\]", lambda m: rf"\p{{{_POSIX[m[1]]}}}", x)
            if ends and ends[-1][0] == "p":
                out.append("(?:")
                ends[-1][1] += 1
            out.append(x)
    return "".join(out)


#: The names of character classes.
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


def longest_match(s: Column, pattern: str) -> Column:
    """The groups (the whole first) of the longest beginning of s that the dialect's pattern matches; null if none that isn't
    empty does.  All beginnings are tried, from the longest, unless the whole text matches: for names and fields, not for long
    texts.  s is evaluated once."""
    java = java_pattern(pattern)
    whole = rf"(?s)\A(?:{java})\z"
    groups = re.compile(re.sub(r"\\p\{[A-Za-z]+\}", "x", java)).groups
    named = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  so that x is evaluated once
    beginnings = lambda x: F.sequence(F.length(x) - 1, F.lit(1), F.lit(-1))
    found = lambda x: F.get(F.filter(beginnings(x), lambda i: x.substr(F.lit(1), i).rlike(whole)), F.lit(0))
    own = named(s, lambda x: F.when(x == "", None).when(x.rlike(whole), x).when(F.length(x) > 1, x.substr(F.lit(1), found(x))))
    return named(own, lambda x: F.when(x.isNotNull(), F.array(x, *(F.regexp_extract(x, whole, k + 1) for k in range(groups)))))
