"""Bases of DNA as Columns.  Sequences are ASCII text; the order of k-mers is A < C < T < G."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement_reversed(s: Column) -> Column:
    """Reverse complement; case, '-' and N are kept, and so are other characters."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def key(kmer: Column) -> Column:
    """Digits whose text order is the order of k-mers."""
    return F.translate(kmer, "ACTG", "0123")


def canonical(kmer: Column) -> Column:
    """The smaller of an upper-case k-mer and its reverse complement, under A < C < T < G."""
    return F.translate(F.least(key(kmer), key(complement_reversed(kmer))), "0123", "ACTG")


def plain_canonical(kmer: Column) -> Column:
    """The same under A < C < G < T."""
    return F.least(kmer, complement_reversed(kmer))


def is_canonical(kmer: Column) -> Column:
    return key(kmer) <= key(complement_reversed(kmer))


def is_palindrome(kmer: Column) -> Column:
    return kmer == complement_reversed(kmer)


def packed(kmer: Column) -> Column:
    """The numeric key of a k-mer of at most 63 bases."""
    return F.aggregate(F.split(key(kmer), ""), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a * 4 + d.cast("decimal(1,0)")).cast("decimal(38,0)"))


def first_kmer(k: int) -> str:
    """The first k-mer in their order; the last is last_kmer."""
    return "A" * k


def last_kmer(k: int) -> str:
    return "G" * k


def unpacked(number: Column, k: int) -> Column:
    """The k-mer of a numeric key, for k up to 32; of 32 bases the key is an unsigned number."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACTG")


def digits(s: Column) -> Column:
    """0 to 4 for A C T G N in either case, 5 for any other letter, as text."""
    return F.translate(F.regexp_replace(s, "[^ACTGNactgn]", "5"), "ACTGNactgn", "0123401234")


def letters(digits_: Column) -> Column:
    return F.translate(digits_, "01234", "ACTGN")


def push_right(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, 2, 1 << 30), base)


def push_left(kmer: Column, base: Column) -> Column:
    return F.concat(base, kmer.substr(F.lit(1), F.length(kmer) - 1))


def runs_squeezed(s: Column) -> Column:
    """Homopolymers reduced to the first letter of each run; letters compare without case."""
    return F.regexp_replace(s, r"(?i)(.)\1+", "$1")


def sub_sequence(s: Column, bgn: Column, end: Column) -> Column:
    """[bgn, end) of a sequence, null if it lies outside."""
    return F.when((bgn >= 0) & (bgn <= end) & (end <= F.length(s)), s.substr(bgn + 1, end - bgn))
