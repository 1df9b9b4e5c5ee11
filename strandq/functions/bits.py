"""Bits, codes and hashes of 64-bit whole numbers as Columns.  Codes are shown as texts of 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_mask(n: Column) -> Column:
    """n low bits set; none for 0, all from 64 on."""
    return F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(F.expr("1L") * F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - n).cast("int")))


def high_mask(n: Column) -> Column:
    """n high bits set; none for 0, all from 64 on."""
    return F.bitwise_not(low_mask(64 - n))


def rotate_left(x: Column, r: int) -> Column:
    r %= 64
    return x if r == 0 else F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r))


def width(x: Column) -> Column:
    """Bits needed; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def binary(x: Column, n: int) -> Column:
    return F.lpad(F.bin(x), n, "0")


def reversed_bits(x: Column) -> Column:
    """The 64 bits in the other order, as text."""
    return F.reverse(binary(x, 64))


def swapped_bytes(x: Column, size: int = 8) -> Column:
    """The `size` lowest bytes in the other order, as hexadecimal text."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(size)])


def two_to_three(x: Column) -> Column:
    """Each pair of bits becomes three: base-4 digits read as octal."""
    return F.conv(F.conv(x.cast("string"), 10, 4), 8, 10).cast("long")


def three_to_two(x: Column) -> Column:
    return F.conv(F.conv(x.cast("string"), 10, 8), 4, 10).cast("long")


def unary(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), n.cast("int")), F.lit("1"))


def gamma(x: Column) -> Column:
    """Elias gamma of a positive number: the length less one in unary, then the bits behind the first."""
    return F.concat(unary(F.length(F.bin(x)) - 1), F.substring(F.bin(x), 2, 64))


def delta(x: Column) -> Column:
    """Elias delta: gamma of the length, then the bits behind the first."""
    return F.concat(gamma(F.length(F.bin(x)).cast("long")), F.substring(F.bin(x), 2, 64))


def fibonacci_numbers(n: int = 91) -> list[int]:
    out = [1, 1]
    while len(out) <= n:
        out.append(out[-1] + out[-2])
    return out[: n + 1]


def fibonacci(n: Column) -> Column:
    """Number n of 1, 1, 2, 3, ... as a decimal, null from 93 on, where they no longer fit 64 bits."""
    return F.get(F.array(*[F.lit(str(f)) for f in fibonacci_numbers(92)]), n.cast("int")).cast("decimal(20,0)")


def zeckendorf(x: Column) -> Column:
    """Fibonacci code of a positive number, smallest term first, ending in 11."""
    terms = [f for f in fibonacci_numbers(90)[1:]]
    start = F.struct(x.cast("long").alias("left"), F.lit("").alias("code"))

    def take(s, f):
        fits = s["left"] >= f
        digit = F.when(fits, "1").when(s["code"] == "", "").otherwise("0")
        return F.struct(F.when(fits, s["left"] - f).otherwise(s["left"]).alias("left"), F.concat(digit, s["code"]).alias("code"))

    done = F.aggregate(F.array(*[F.lit(f).cast("long") for f in reversed(terms)]), start, take)
    return F.concat(done["code"], F.lit("1"))


_ALL = (1 << 64) - 1


def _masked(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def clear_left(x: Column, n: int) -> Column:
    """The n highest bits become 0; from 64 on, all."""
    return _masked(x, _ALL >> min(n, 64))


def keep_left(x: Column, n: int) -> Column:
    return _masked(x, _ALL ^ (_ALL >> min(n, 64)))


def clear_right(x: Column, n: int) -> Column:
    return _masked(x, _ALL ^ ((1 << min(n, 64)) - 1))


def keep_right(x: Column, n: int) -> Column:
    return _masked(x, (1 << min(n, 64)) - 1)


def keep_middle(x: Column, left: int, right: int) -> Column:
    """What lies between the `left` highest and the `right` lowest bits."""
    return clear_right(clear_left(x, left), right)


def clear_middle(x: Column, left: int, right: int) -> Column:
    return keep_left(x, left).bitwiseOR(keep_right(x, right))


def rotate_right(x: Column, r: int) -> Column:
    return rotate_left(x, -r)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (63 - i % 64).cast("int"))


def get_bit(words: Column, i: Column) -> Column:
    """Bit i of an array of 64-bit words, the highest bit of the first word being 0; null outside."""
    return F.call_function("shiftrightunsigned", F.get(words, F.floor(i / 64).cast("int")), (63 - i % 64).cast("int")).bitwiseAND(1).cast("int")


def set_bit(words: Column, i: Column, on: bool) -> Column:
    """The array with bit i set or cleared; unchanged if i lies outside."""
    new = (lambda w: w.bitwiseOR(_bit(i))) if on else (lambda w: w.bitwiseAND(F.bitwise_not(_bit(i))))
    return F.transform(words, lambda w, k: F.when(k == F.floor(i / 64), new(w)).otherwise(w))


def flip_bit(words: Column, i: Column) -> Column:
    return F.transform(words, lambda w, k: F.when(k == F.floor(i / 64), w.bitwiseXOR(_bit(i))).otherwise(w))
