"""Streams of variable-length codes: arrays of numbers to one text of bits and back.  The codes of single numbers are in bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits

#: The codes, by name; fixed takes a width.
CODES = ("unary", "gamma", "delta", "zeckendorf", "fixed")


def code(x: Column, name: str, width: int = 0) -> Column:
    """A number's bits: unary from 0, gamma, delta and zeckendorf from 1, fixed of so many bits (its lowest)."""
    if name == "fixed":
        return F.right(F.concat(F.repeat(F.lit("0"), F.lit(width)), F.bin(x)), F.lit(width))
    return {"unary": bits.unary, "gamma": bits.gamma, "delta": bits.delta, "zeckendorf": bits.zeckendorf}[name](x)


def encoded(values: Column, *kinds: str | tuple[str, int]) -> Column:
    """The bits of an array of numbers, coded by the kinds in turn: 'gamma', ('fixed', 7).  Null for a null array; null numbers are left out."""
    named = [(k, 0) if isinstance(k, str) else k for k in kinds]

    def one(x: Column, i: Column) -> Column:
        out = code(x, *named[-1])
        for n in reversed(range(len(named) - 1)):
            out = F.when(i % len(named) == n, code(x, *named[n])).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(values, lambda x: x.isNotNull()), one), "")


class _Reader:
    """Walks a text of bits; each method reads one number, and raises ValueError where the bits end within it."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def unary(self) -> int:
        stop = self.text.index("1", self.at)
        n, self.at = stop - self.at, stop + 1
        return n

    def fixed(self, width: int) -> int:
        end = self.at + width
        if end > len(self.text):
            raise ValueError
        part, self.at = self.text[self.at : end], end
        return int(part or "0", 2)

    def gamma(self) -> int:
        n = self.unary()
        return 1 << n | self.fixed(n)

    def delta(self) -> int:
        n = self.gamma() - 1
        if n > 64:
            raise ValueError
        return 1 << n | self.fixed(n)

    def zeckendorf(self) -> int:
        stop = self.text.index("11", self.at)
        a, b, total = 1, 2, 0
        for c in self.text[self.at : stop + 1]:
            total += a * (c == "1")
            a, b = b, a + b
        self.at = stop + 2
        return total


def decode(text: str, kinds: list[tuple[str, int]]) -> list[int] | None:
    reader, out = _Reader(text), []
    try:
        while reader.at < len(text):
            name, width = kinds[len(out) % len(kinds)]
            out.append(reader.fixed(width) if name == "fixed" else getattr(reader, name)())
    except ValueError:
        return None
    return out if all(x < 1 << 63 for x in out) else None


def decoded(text: Column, *kinds: str | tuple[str, int]) -> Column:
    """The numbers of a text of bits as encoded() gives it.  Null for a null text, for other letters than 0 and 1, for bits that end
    within a code, and for numbers of over 63 bits; an empty text has no numbers."""
    named = [(k, 0) if isinstance(k, str) else k for k in kinds]
    if any(name not in CODES or (name == "fixed" and not 0 < width < 64) for name, width in named):
        raise ValueError(f"codes are {', '.join(CODES)}, fixed with a width from 1 to 63")

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else decode(t, named) for t in texts], dtype=object)

    return run(F.when(text.rlike("^[01]*$"), text))
