"""What base qualities say: realignment of reads by a profile hidden Markov model, and likelihoods of genotypes from the
bases of a position."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piles

#: The chances of opening and of extending a gap, for reads of up to LONG bases and for longer ones; the chance
#: of an inserted base, and of each other base than the right one; the reach of the band; the decibels of a natural logarithm.
LONG, SHORT_GAPS, LONG_GAPS = 1000, (0.001, 0.1), (1e-7, 0.1)
INSERTED, OTHER, REACH, DECIBELS = 0.25, 0.33333333333, 7, 4.343
_CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODES[[ord(_c), ord(_c.lower())]] = _i


def base_codes(text: str) -> np.ndarray:
    """0 to 3 for A C G T, 4 for all else."""
    return _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def posteriors(ref: np.ndarray, query: np.ndarray, error: np.ndarray, reach: int, gaps: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each base of each of several reads of one length the place in the reference it most likely stands at, whether it is
    inserted there, and the phred quality of that.

    ref (reads, places) and query (reads, bases) are codes, error (reads, bases) the chances of a wrong base.  Forward and
    backward chances of matches, insertions and deletions are kept in a band of `reach` places to both sides of the
    diagonal, each row scaled to sum to one, and computed for all reads and all places of a band at once.  Only deletions
    follow one another within a row: a match that opens one counts for all places behind it, less for each.
    """
    count, n, m = len(query), query.shape[1], ref.shape[1]
    reach = max(min(reach, max(n, m)), abs(m - n))
    opened, longer = gaps
    leave = 1 / (2 * n + 2)
    mm, mi, md = (1 - 2 * opened) * (1 - leave), opened * (1 - leave), opened * (1 - leave)
    im, ii = (1 - longer) * (1 - leave), longer * (1 - leave)
    dm, dd = 1 - longer, longer
    width = 2 * reach + 1
    # Column c of row i is place i - reach + c of the reference, counted from 1.
    place = lambda i: np.arange(width) + i - reach
    padded = np.full((count, m + 2 * width + n), 5, np.uint8)
    padded[:, width : width + m] = ref

    def emitted(i: int) -> np.ndarray:
        """The chance of base i (from 1) at each place of its band; 0 beyond the reference."""
        at = i - reach - 1 + width
        there, own = padded[:, at : at + width], query[:, i - 1 : i]
        wrong = error[:, i - 1 : i]
        out = np.where((there > 3) | (own > 3), 1.0, np.where(there == own, 1 - wrong, wrong * OTHER))
        return np.where(there == 5, 0.0, out)

    inside = lambda i: (place(i) >= 1) & (place(i) <= m)
    later = lambda x: np.pad(x, ((0, 0), (0, 1)))[:, 1:]  # noqa: E731  the same place in the row before
    sooner = lambda x: np.pad(x, ((0, 0), (1, 0)))[:, :-1]
    terms = min(width, 1 + math.ceil(40 / -math.log10(dd))) if dd else 1

    def spread(x: np.ndarray, step) -> np.ndarray:
        """What opens at each place, and goes on to those behind it (step by step less)."""
        out, part = np.zeros_like(x), x
        for _ in range(terms):
            part = step(part)
            out += part
            part = part * dd
        return out

    scale = np.ones((n + 2, count, 1))
    forward = np.zeros((n + 1, 2, count, width))
    gone = np.zeros((count, width))
    for i in range(1, n + 1):
        if i == 1:
            match, insert = emitted(1) * (1 - opened) / m, np.where(inside(1), INSERTED * opened / m, 0.0)
            match, insert = match * inside(1), np.repeat(insert[None], count, 0)
            gone = np.zeros((count, width))
        else:
            old_match, old_insert = forward[i - 1]
            match = emitted(i) * (mm * old_match + im * old_insert + dm * gone)
            insert = INSERTED * (mi * later(old_match) + ii * later(old_insert)) * inside(i)
            gone = spread(md * match, sooner) * inside(i)
        scale[i] = (match + insert + gone).sum(axis=1, keepdims=True)
        forward[i] = match / scale[i], insert / scale[i]
        gone = gone / scale[i]
    scale[n + 1] = (leave * (forward[n, 0] + forward[n, 1])).sum(axis=1, keepdims=True)

    placed, inserted, chance = np.zeros((count, n), np.int64), np.zeros((count, n), bool), np.zeros((count, n))
    back_match = back_insert = leave / scale[n + 1] * inside(n) * np.ones((count, 1))
    for i in range(n, 0, -1):
        if i < n:
            on = emitted(i + 1) * back_match / scale[i + 1]
            stay = INSERTED * sooner(back_insert) / scale[i + 1]
            lost = (dm * on if i > 1 else np.zeros_like(on)) * inside(i)
            lost = lost + dd * spread(lost, later)  # that a deletion ends at this place or at one behind it
            back_match, back_insert = (mm * on + mi * stay + md * later(lost)) * inside(i), (im * on + ii * stay) * inside(i)
        both = np.stack([forward[i, 0] * back_match, forward[i, 1] * back_insert], axis=2).reshape(count, -1)
        best = both.argmax(axis=1)
        placed[:, i - 1], inserted[:, i - 1] = best // 2 + i - reach - 1, best % 2 == 1
        chance[:, i - 1] = both[np.arange(count), best] / both.sum(axis=1)
    with np.errstate(divide="ignore"):
        quality = np.minimum(-DECIBELS * np.log(np.maximum(1 - chance, 0)) + 0.499, 1e6).astype(np.int64)
    return placed, inserted, np.where(quality > 100, 99, quality)


def _blocks(cigar: str) -> list[tuple[str, int]]:
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            out.append((c, int(n)))
            n = ""
    return out


def _window(pos: int, ops: list[tuple[str, int]], length: int) -> tuple[int, int, int] | None:
    """The stretch of the reference that a read is realigned to, and the reach of the band; None for a read without matches or
    with a skipped stretch."""
    x, y, first, last = pos, 0, None, None
    for op, n in ops:
        if op in "M=X":
            first = first or (x, y)
            x, y = x + n, y + n
            last = (x, y)
        elif op in "SI":
            y += n
        elif op == "D":
            x += n
        elif op == "N":
            return None
    if last is None:
        return None
    unlike = abs((last[0] - first[0]) - (last[1] - first[1]))
    reach = unlike + 3 if unlike > REACH else REACH
    begin = max(0, first[0] - first[1] - reach // 2)
    end = last[0] + length - last[1] + reach // 2
    over = end - begin - length
    if over > reach:
        begin += (over - reach) // 2
        end -= (end - begin - length - reach) // 2
    return begin, end, reach


def _capped(pos: int, ops: list[tuple[str, int]], qual: np.ndarray, begin: int, placed: np.ndarray, inserted: np.ndarray, quality: np.ndarray, extended: bool) -> np.ndarray:
    out = qual.copy()
    sure = np.where(inserted, 0, quality)
    x, y = pos, 0
    for op, n in ops:
        if op in "M=X":
            n_own = min(n, len(qual) - y)
            own = slice(y, y + n_own)
            good = np.where(placed[own] == x - begin + np.arange(n_own), sure[own], 0)
            if extended and n_own:
                good = np.minimum(np.maximum.accumulate(good), np.maximum.accumulate(good[::-1])[::-1])
            out[own] = np.minimum(qual[own], good)
            x, y = x + n, y + n
        elif op in "SI":
            y += n
        elif op == "D":
            x += n
    return out


def realigned(reads: DataFrame, extended: bool = False) -> DataFrame:
    """reads (pos from 0, cigar, seq, qual as phred + 33, ref, and others) with capped: qualities lowered to what the place of
    each base is worth, by realigning the read to the reference around it.

    ref is the reference's text from the place `ref_bgn` on (0 without that column); what lies outside of it isn't there.
    Matched bases get the smaller of their quality and that of standing where the alignment puts them, 0 if they
    more likely stand elsewhere; `extended` lets a base count as well as the best ones to both sides of it.  Inserted and
    clipped bases keep theirs.  capped is null where nothing can be said: without bases, qualities, reference, a valid
    cigar or any matches, with a skipped stretch, or with lengths of cigar, bases and qualities that differ.  Reads of
    one length and reach are worked on together; memory is that of their bands.
    """

    @F.pandas_udf("string")
    def run(pos: pd.Series, cigar: pd.Series, seq: pd.Series, qual: pd.Series, ref: pd.Series, start: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(seq)
        alike: dict[tuple, list] = {}
        for k, (at, ops, s, q, r, bgn) in enumerate(zip(pos, cigar, seq, qual, ref, start, strict=True)):
            if at is None or at != at or not s or not q or len(s) != len(q) or not r or not ops:
                continue
            ops = _blocks(ops)
            window = _window(int(at), ops, len(s)) if sum(n for op, n in ops if op in "MIS=X") == len(s) else None
            if window is None:
                continue
            begin, end = max(window[0], int(bgn)), min(window[1], int(bgn) + len(r))
            if begin < end:
                alike.setdefault((len(s), end - begin, window[2]), []).append((k, int(at), ops, s, q, r[begin - int(bgn) : end - int(bgn)], begin))
        for (n, m, reach), some in alike.items():
            step = max(1, (1 << 22) // (n * (2 * max(reach, abs(m - n)) + 1)))
            for lo in range(0, len(some), step):
                part = some[lo : lo + step]
                quals = np.array([np.frombuffer(x[4].encode("latin-1", "replace"), np.uint8) for x in part]).astype(np.int64) - 33
                found = posteriors(np.array([base_codes(x[5]) for x in part]), np.array([base_codes(x[3]) for x in part]), 10 ** (-quals / 10), reach, LONG_GAPS if n > LONG else SHORT_GAPS)
                for (k, at, ops, _, _, _, begin), own, *x in zip(part, quals, *found, strict=True):
                    out[k] = (_capped(at, ops, own, begin, *x, extended) + 33).astype(np.uint8).tobytes().decode("latin-1")
        return pd.Series(out, dtype=object)

    valid = F.when(F.col("cigar").rlike("^([0-9]+[MIDNSHP=X])+$"), F.col("cigar"))
    start = F.col("ref_bgn").cast("long") if "ref_bgn" in reads.columns else F.lit(0).cast("long")
    return reads.withColumn("capped", run(F.col("pos").cast("long"), valid, F.col("seq"), F.col("qual"), F.col("ref"), start))


#: Pieces of the reference that reads are joined with.
PIECE = 1 << 10


def with_reference(reads: DataFrame, reference: DataFrame, flank: int = 64) -> DataFrame:
    """reads (id, unique; chrom, pos from 0, cigar, ...) with ref and ref_bgn, the text of the reference (chrom, bases) around
    each, `flank` more to both sides: cut to pieces, so that no task holds a whole sequence.  Reads without a reference or
    a valid cigar are left out."""
    from . import sequences

    pieces = reference.select("chrom", F.posexplode(sequences.pieces(F.col("bases"), PIECE)).alias("piece", "text"))
    size = sequences.totals(sequences.cigar(F.col("cigar")), {"n": "MDN=X"})["n"]
    clipped = sequences.totals(sequences.cigar(F.col("cigar")), {"n": "S"})["n"] + flank
    asked = reads.select("id", "chrom", F.explode(F.sequence(F.floor(F.greatest(F.col("pos") - clipped, F.lit(0)) / PIECE), F.floor((F.col("pos") + size + clipped) / PIECE))).alias("piece"))
    found = asked.join(pieces, ["chrom", "piece"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))  # the pieces that one read covers
    found = found.select("id", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("ref"), (F.col("parts")[0]["piece"].cast("long") * PIECE).alias("ref_bgn"))
    return reads.join(found, "id")


#: How little each further error of one strand and base depends on those before it, the least share that still
#: counts, and the least and greatest quality.
DEPENDENT, LEAST_SHARE, QUALITIES = 0.17, 0.03, (4, 63)
GENOTYPES = [a + b for i, a in enumerate("ACGT") for b in "ACGT"[i:]]


def further_error(quality: int, depth: int) -> np.ndarray:
    """For k from 0: the phred chance that one more than k of `depth` bases are wrong, when k are and each is with the chance of its quality."""
    k, wrong = np.arange(depth + 1), 10 ** (-quality / 10)
    log_factorial = np.append(0.0, np.cumsum(np.log(np.arange(1, depth + 1))))
    terms = log_factorial[depth] - log_factorial - log_factorial[::-1] + k * math.log(wrong) + (depth - k) * math.log1p(-wrong)
    tails = np.logaddexp.accumulate(terms[::-1])[::-1]  # of k or more
    return np.append(-10 / math.log(10) * (tails[1:] - tails[:-1]), np.inf)


#: Up to this depth many positions are worked on at once; what further errors say is kept for so many depths.
HELD, KEPT = 1 << 9, 1 << 7


@lru_cache(maxsize=KEPT)
def _held(depth: int) -> np.ndarray:
    """further_error of all qualities at a depth, one after the other."""
    return np.concatenate([further_error(q, depth) for q in range(QUALITIES[0], QUALITIES[1] + 1)])


def likelihoods_of_many(position: np.ndarray, quality: np.ndarray, strand: np.ndarray, base: np.ndarray, n: np.ndarray, dependent: float = DEPENDENT) -> tuple[np.ndarray, np.ndarray]:
    """depth, and the likelihoods as rows of ten, of positions numbered from 0, each with at least one base: what likelihoods_of says of
    the counts of each."""
    key, n = piles.summed((((position * 64 + 63 - quality) * 2 + 1 - strand) * 4) + 3 - base, n)  # best qualities first
    depth = piles.summed(key // 512, n)[1]
    out = np.zeros((len(depth), len(GENOTYPES)))
    position = key // 512
    deep = depth[position] > HELD
    for k in np.flatnonzero(depth > HELD):
        lo, hi = np.searchsorted(position, [k, k + 1])
        out[k] = likelihoods_of([(63 - x // 8 % 64, 1 - x // 4 % 2, 3 - x % 4, c) for x, c in zip(key[lo:hi].tolist(), n[lo:hi].tolist(), strict=True)], dependent)
    each = np.repeat(key[~deep], n[~deep])
    if not len(each):
        return depth, out
    position, quality, strand, base = each // 512, 63 - each // 8 % 64, 1 - each // 4 % 2, 3 - each % 4

    def nth(group: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
        place = np.empty(len(order), np.int64)
        place[order] = piles.within(np.diff(first, append=len(order)))[1]
        return place

    own = position * 4 + base
    seen, before = nth(own), nth(own * 2 + strand)
    depths, which = np.unique(depth[position], return_inverse=True)
    tables = [_held(int(d)) for d in depths]
    errors = np.concatenate(tables)[piles.starts([len(t) for t in tables])[which] + (quality - QUALITIES[0]) * (depths[which] + 1) + seen]
    weights = ((1 - dependent) ** np.arange(HELD))[before] * (1 - LEAST_SHARE) + LEAST_SHARE
    costs = np.bincount(own, weights * errors, minlength=len(depth) * 4).reshape(-1, 4)
    number = np.bincount(own, minlength=len(depth) * 4).reshape(-1, 4)
    shallow, log_gamma = depth <= HELD, np.array([math.lgamma(k + 1) for k in range(HELD + 1)])
    for x, (i, j) in enumerate((i, j) for i in range(4) for j in range(i, 4)):
        rest = sum((costs[:, k] for k in range(4) if k not in (i, j)), np.zeros(len(depth)))
        if i != j:
            both = number[:, i] + number[:, j]
            rest = rest - DECIBELS * (log_gamma[both] - log_gamma[number[:, i]] - log_gamma[number[:, j]] - both * math.log(2))
        out[shallow, x] = np.maximum(rest, 0.0)[shallow]
    return depth, out


def likelihoods_of(counts: list[tuple[int, int, int, int]], dependent: float = DEPENDENT) -> list[float] | None:
    """The phred likelihoods of GENOTYPES from (quality, strand, base, number) of a position; None without any base.

    Bases are taken from the best quality down.  Each of one strand and base counts less than the one before it, and what
    it counts is the chance of one more error than so far.
    """
    depth = sum(n for *_, n in counts)
    if not depth:
        return None
    shares = (1 - dependent) ** np.arange(max(n for *_, n in counts))
    seen, strands, costs = [0] * 4, {}, [0.0] * 4
    for quality, strand, base, n in sorted(counts, reverse=True):
        before, k = strands.get((strand, base), 0), seen[base]
        errors = further_error(quality, depth)
        part = (1 - dependent) ** before * (1 - LEAST_SHARE)
        if n == 1:
            costs[base] += (part + LEAST_SHARE) * float(errors[k])
        else:
            costs[base] += float(((part * shares[:n] + LEAST_SHARE) * errors[k : k + n]).sum())
        seen[base] = k + n
        strands[strand, base] = before + n
    out = []
    for i in range(4):
        for j in range(i, 4):
            rest = sum(costs[k] for k in range(4) if k not in (i, j))
            if i != j:
                both = seen[i] + seen[j]
                rest -= DECIBELS * (math.lgamma(both + 1) - math.lgamma(seen[i] + 1) - math.lgamma(seen[j] + 1) - both * math.log(2))
            out.append(max(0.0, rest))
    return out


def genotype_likelihoods(bases: DataFrame, *by: str, dependent: float = DEPENDENT) -> DataFrame:
    """chrom, pos, depth, likelihoods (ten phred numbers, of AA, AC, AG, AT, CC, CG, CT, GG, GT, TT) of rows (chrom, pos, base,
    quality, strand 0 or 1), apart for each value of the columns `by`, such as a sample.

    Rows are counted per quality, strand and base before the shuffle, so that a position is at most 480 numbers, however
    deep it is, and all of its bases count.  Qualities are taken between QUALITIES; other letters than A C G T, null bases,
    qualities and strands count for nothing; positions with no other have no row.
    """

    @F.arrow_udf("array<double>")
    def run(columns: pa.Array) -> pa.Array:
        position = np.repeat(np.arange(len(columns)), np.asarray(pc.list_value_length(columns)))
        x = np.asarray(columns.flatten())
        found = likelihoods_of_many(position, x >> 43, x >> 42 & 1, x >> 40 & 3, x & (1 << 40) - 1, dependent)[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(GENOTYPES)), pa.array(found.ravel()))

    b = F.expr("instr('ACGT', upper(base)) - 1")
    q = F.greatest(F.least(F.col("quality"), F.lit(QUALITIES[1])), F.lit(QUALITIES[0])).cast("int")
    some = bases.filter("base is not null and length(base) = 1 and upper(base) in ('A', 'C', 'G', 'T') and quality is not null and strand in (0, 1)")
    counted = some.groupBy(*by, "chrom", "pos", q.alias("q"), "strand", b.alias("b")).agg(F.count("*").alias("n"))
    columns = counted.groupBy(*by, "chrom", "pos").agg(F.sum("n").alias("depth"), F.collect_list(F.expr("shiftleft(cast((q * 2 + strand) * 4 + b as bigint), 40) + n")).alias("counts_"))
    return columns.withColumn("likelihoods", run("counts_")).drop("counts_")


def read_likelihoods(reads: DataFrame, *by: str, dependent: float = DEPENDENT) -> DataFrame:
    """genotype_likelihoods of the positions that reads (chrom, pos, cigar, seq, qual, strand) cover, apart for each value of the
    columns `by`, counted in packed rows before the one shuffle; deletions count for nothing."""
    keys = [*by, "chrom"]
    letter = np.full(256, 4)
    letter[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2

    def finish(table: pa.Table, group: np.ndarray) -> pa.Table:
        strand, bins = np.asarray(table["strand"].combine_chunks()).astype(np.int64), table["bin"].combine_chunks()
        row, place, base, mark, n = piles.entries(table, keys)
        base = letter[np.minimum(base, 255)]
        some = (base < 4) & (mark > 0)
        row, place, base, n = row[some], place[some], base[some], n[some]
        quality = np.clip(mark[some] - 33, *QUALITIES)
        each, position = np.unique(group[row] * piles.BIN + place, return_inverse=True)
        depth, found = likelihoods_of_many(position, quality, strand[row], base, n, dependent)
        first = np.zeros(len(each), np.int64)
        first[position[::-1]] = row[::-1]
        where = pa.array(first)
        pos = pc.add(pc.multiply(bins.take(where), piles.BIN), pa.array(each % piles.BIN))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * len(GENOTYPES)), pa.array(found.ravel()))
        return pa.table([*(table[c].combine_chunks().take(where) for c in keys), pos, pa.array(depth), rows], names=[*keys, "pos", "depth", "likelihoods"])

    return piles.counted(reads.filter("strand in (0, 1)"), keys, ["strand"], finish, "pos long, depth long, likelihoods array<double>", behind=False)
