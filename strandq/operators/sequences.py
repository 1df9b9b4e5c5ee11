"""Sequences as rows: chunks, squeezed runs with maps, packed bases, and CIGAR texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import piles


def pieces(text: Column, most: int) -> Column:
    """A text cut each `most` characters, in one pass over it; null and empty texts have no piece."""
    return F.when(F.length(text) > 0, F.split(text, rf"(?s)(?<=\G.{{{most}}})(?!\z)"))


def chunked(reads: DataFrame, most: int, overlap: int = 0) -> DataFrame:
    """seq_idx, chunk, bgn, piece, is_last: pieces of at most `most` new bases, led by `overlap` earlier ones."""
    step = max(most, overlap)  # so that what leads a piece lies within the one before it
    if step > most:
        raise ValueError("the overlap must not exceed the pieces")
    cut = reads.select("seq_idx", pieces(F.col("bases"), most).alias("p"))
    n = F.size("p")
    led = F.transform("p", lambda x, i: F.concat(F.when(i > 0, F.right(F.get("p", i - 1), F.lit(overlap))).otherwise(""), x)) if overlap else F.col("p")
    out = cut.select("seq_idx", n.alias("n"), F.posexplode(led).alias("chunk", "piece"))
    bgn = F.greatest(F.col("chunk") * most - overlap, F.lit(0))
    return out.select("seq_idx", "chunk", bgn.alias("bgn"), "piece", (F.col("chunk") == F.col("n") - 1).alias("is_last"))


def squeezed_map(bases: Column) -> Column:
    """For each position, and the end, its place in the text with runs squeezed: runs that begin before it, less one within a run."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            x = np.frombuffer(t.upper().encode("utf-32-le"), np.uint32)
            fresh = np.append(np.diff(x) != 0, True) if len(x) else np.zeros(0, bool)  # whether a run ends with each letter
            return np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32)

        return texts.map(one)

    return run(bases)


def _pack(bits: int):
    alphabet = {2: "ACGT", 3: "ACGTN"}[bits]
    base, per = {2: (4, 4), 3: (5, 3)}[bits]

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or x.upper().strip(alphabet):
                return None
            digits = [alphabet.index(c) for c in x.upper()]
            digits += [0] * (-len(digits) % per)
            return bytes(sum(d * base ** (per - 1 - j) for j, d in enumerate(digits[i : i + per])) for i in range(0, len(digits), per))
        return s.map(one)

    @F.pandas_udf("string")
    def unpack(b: pd.Series, n: pd.Series) -> pd.Series:
        def one(x, m):
            return None if x is None else "".join(alphabet[v // base ** (per - 1 - j) % base] for v in x for j in range(per))[: int(m)]
        return pd.Series([one(x, m) for x, m in zip(b, n, strict=True)], dtype=object)

    return pack, unpack


def packed(bases: Column, bits: int = 2) -> Column:
    """Four bases (bits 2) or three bases or N (bits 3) per byte; null if another letter occurs."""
    return _pack(bits)[0](bases)


def unpacked(data: Column, length: Column, bits: int = 2) -> Column:
    return _pack(bits)[1](data, length)


def cigar(text: Column) -> Column:
    """Array of n, op; null for a text that isn't one."""
    kinds = F.split(F.translate(text, "0123456789", ""), "")
    ops = F.arrays_zip(F.slice(F.split(text, "[MIDNSHP=X]"), F.lit(1), F.size(kinds)).alias("n"), kinds.alias("op"))
    return F.when(text.rlike(piles.VALID), F.transform(ops, lambda x: F.struct(x["n"].cast("long").alias("n"), x["op"].alias("op"))))


#: Which operations each total counts.
TOTALS = {"query_len": "MIS=X", "ref_len": "MDN=X", "columns": "MID=X", "gaps": "ID", "matches": "=", "mismatches": "X"}


def totals(ops: Column, kinds: dict[str, str] = TOTALS) -> Column:
    """A struct of the bases of the operations of some kinds, in one pass over an array of n, op; null for a null array."""
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in kinds))
    add = lambda a, x: F.struct(*((a[k] + F.when(x["op"].isin(*o), x["n"]).otherwise(F.lit(0).cast("long"))).alias(k) for k, o in kinds.items()))
    return F.aggregate(ops, zero, add)


def tallies(rows: DataFrame) -> DataFrame:
    """id, query_len, ref_len, columns, gaps, matches, mismatches of rows (id, cigar); null where cigar isn't one."""
    return rows.select("id", totals(cigar(F.col("cigar"))).alias("t")).select("id", "t.*")


def _laid_out(text: Column) -> Column:
    """op, n, a, b, inserted for each operation of a text; null for one that isn't a cigar: where it begins in query and reference, and how many bases
    the insertions directly behind it have (padding and empty operations between don't part them)."""

    @F.arrow_udf("array<struct<op:string,n:long,a:long,b:long,inserted:long>>")
    def run(arrays: pa.Array) -> pa.Array:
        sizes, _, kind, *numbers = piles.laid_out(arrays)
        each = pa.StructArray.from_arrays([piles.KINDS.take(pa.array(kind)), *map(pa.array, numbers)], ["op", "n", "a", "b", "inserted"])
        bounds = pa.array(piles.starts(sizes).astype(np.int32), mask=np.append(np.asarray(pc.is_null(arrays)), False))
        return pa.ListArray.from_arrays(bounds, each)

    return run(F.when(text.rlike(piles.VALID), text))


def placed(rows: DataFrame, *keep: str) -> DataFrame:
    """op, n, a, b, inserted of each operation of rows (cigar, pos): its length, where it begins in query and reference, and the
    bases inserted behind it; with the columns to keep."""
    ops = rows.select(*keep, "pos", _laid_out(F.col("cigar")).alias("ops"))
    return ops.select(*keep, "pos", F.explode("ops").alias("x")).select(*keep, "x.op", "x.n", "x.a", (F.col("x.b") + F.col("pos")).alias("b"), "x.inserted")


def columns(rows: DataFrame) -> DataFrame:
    """id, op, a_pos, b_pos: one row per alignment column of rows (id, cigar, pos), positions from 0 and from pos."""
    eats = lambda kinds: F.col("op").isin(*kinds)
    each = placed(rows, "id").filter(eats("MID=X") & (F.col("n") > 0)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("id", "op", F.when(eats("MI=X"), F.col("a") + F.col("k")).alias("a_pos"), F.when(eats("MD=X"), F.col("b") + F.col("k")).alias("b_pos"))


def column_sums(rows: DataFrame) -> DataFrame:
    """id, op, n, sum_a, sum_b, sum_ab: how many columns() of each id and operation there are, and the sums of their positions
    and of the products of these.  Reads are shuffled, not their columns nor sums."""
    return piles.column_sums(rows)


def covered(rows: DataFrame, *keep: str) -> DataFrame:
    """chrom, pos, base, quality, inserted, with the columns to keep: a row for each position that a read of rows (chrom, pos,
    cigar, seq, qual) covers.  base is '-' for a deletion, quality comes from qual, a text of phred + 33, of a deletion from
    the base before it; inserted are the bases that the read has between this position and the next, if any.

    Inserted bases before a read's first position belong to none.  Reads without a valid cigar and skipped stretches cover
    nothing.  Null sequences and qualities give null bases and qualities, as do those shorter than their cigar.
    """
    rows = rows.withColumn("read_", F.struct("seq", F.col("qual").cast("string").alias("qual")))
    some = placed(rows, "chrom", "read_", *keep).filter(F.col("op").isin(*"MD=X") & (F.col("n") > 0))
    n, seq, qual, lost = F.col("n").cast("int"), F.col("read_.seq"), F.col("read_.qual"), F.col("op") == "D"
    cut = lambda text, at, k: text.substr((at + 1).cast("int"), k.cast("int"))
    filled = lambda text: F.split(F.rpad(F.coalesce(text, F.lit("")), n, F.lit("\0")), "")
    before = F.when(F.col("a") > 0, cut(qual, F.col("a") - 1, F.lit(1)))
    inserted = F.when(F.col("inserted") > 0, cut(seq, F.col("a") + F.when(lost, 0).otherwise(F.col("n")), F.col("inserted")))
    letters = F.when(lost, F.array_repeat(F.lit("-"), n)).otherwise(filled(cut(seq, F.col("a"), n)))
    marks = F.when(lost, F.array_repeat(F.coalesce(before, F.lit("")), n)).otherwise(filled(cut(qual, F.col("a"), n)))
    each = some.select("chrom", *keep, "b", (n - 1).alias("last"), inserted.alias("behind"), F.posexplode(F.arrays_zip(letters.alias("base"), marks.alias("mark"))).alias("k", "x"))
    there = lambda c: F.when(~F.col(c).isin("", "\0"), F.col(c))
    return each.select("chrom", *keep, (F.col("b") + F.col("k")).alias("pos"), there("x.base").alias("base"), (F.ascii(there("x.mark")) - 33).alias("quality"), F.when(F.col("k") == F.col("last"), F.col("behind")).alias("inserted"))


def pileup(rows: DataFrame, *by: str) -> DataFrame:
    """chrom, pos, base, inserted, n, quality of rows (chrom, pos, cigar, seq, and qual if there): how many reads have each base,
    with the same bases inserted behind it, at each position, and the sum of their qualities; '-' for a deletion; apart for
    each value of the columns `by`, such as a sample or a strand.  Bases are counted in packed rows before the one shuffle."""
    rows = rows if "qual" in rows.columns else rows.withColumn("qual", F.lit(None).cast("string"))
    return piles.pileup(rows, [*by, "chrom"])
