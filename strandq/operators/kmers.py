"""K-mers: enumeration, counting, merging, histograms, and lookup as joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from . import sequences, skew
from .piles import starts, within
from .stats import ordered_cells

SATURATED = (1 << 32) - 1


#: Sequences are cut to pieces of this many bases before their windows are taken, as a place in a long text is slow to find.
PIECE = 256
#: Bases that are packed at once: memory follows this and the longest sequence.
BLOCK = 1 << 20


def enumerate_kmers(reads: DataFrame, k: int, with_invalid: bool = False) -> DataFrame:
    """seq_idx, pos, fwd, rc of every window of k bases without other letters; with_invalid keeps those, marked by valid."""
    most = max(PIECE, k)
    parts = sequences.chunked(reads, most, k - 1)
    out = parts.select("seq_idx", "bgn", "piece", F.explode(F.when(F.length("piece") >= k, F.sequence(F.lit(0), F.length("piece") - k))).alias("at"))
    out = out.select("seq_idx", (F.col("bgn") + F.col("at")).alias("pos"), F.upper(F.col("piece").substr(F.col("at") + 1, F.lit(k))).alias("fwd"))
    valid = F.col("fwd").rlike("^[ACGT]+$")
    out = out.withColumn("valid", valid) if with_invalid else out.filter(valid)
    return out.withColumn("rc", B.complement_reversed(F.col("fwd")))


#: Bases of a 64-bit word, and of a packed k-mer, which has one or two words.
WORD, MOST = 32, 64


def packed_columns(k: int) -> list[str]:
    """The columns of a packed k-mer: one number up to 31 bases, beyond that one of the bases before the last 32, and one of these."""
    if not 0 < k <= MOST:
        raise ValueError(f"k-mers of 1 to {MOST} bases can be packed, not of {k}")
    return ["packed"] if k < WORD else ["packed_hi", "packed"]


#: The digit of each letter (A 0, C 1, T 2, G 3 in either case; a complement differs by 2), and 4 for all others.
DIGITS = np.full(256, 4, np.uint8)
DIGITS[list(b"ACTGactg")] = [0, 1, 2, 3] * 2


def _words(digit: np.ndarray, size: int, turned: bool) -> np.ndarray:
    """The word of `size` digits from each place on, the last ones first if turned: of words of 1, 2, 4... digits those that make up size."""
    if not size:
        return np.zeros(len(digit) + 1, np.uint64)
    join = lambda x, n, y, m: (y << np.uint64(2 * n) | x) if turned else (x << np.uint64(2 * m) | y)
    out, have, step, wide = None, 0, digit, 1
    while wide <= size:
        if size & wide:
            if out is None:
                out = step
            else:
                n = len(step) - have
                out = join(out[:n], have, step[have:], wide)
            have += wide
        step, wide = join(step[:-wide], wide, step[wide:], wide) if 2 * wide <= size else step, 2 * wide
    return out


def windows(bases: bytes, k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Places, and two-bit packed windows with their reverse complements, of a sequence, as the words of packed_columns(k); those
    with another letter are left out."""
    return _windows(DIGITS[np.frombuffer(bases, np.uint8)], k)


def _windows(digits: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """The same of a sequence's DIGITS."""
    sizes = [k] if len(packed_columns(k)) == 1 else [k - WORD, WORD]
    begins = np.cumsum([0, *sizes[:-1]]).tolist()
    for lo in range(0, max(0, len(digits) - k + 1), BLOCK):
        small = digits[lo : lo + BLOCK + k - 1]
        digit, n = (small & 3).astype(np.uint64), len(small) - k + 1
        good = np.flatnonzero(_whole(small, k))
        keep = (lambda x: x) if len(good) == n else (lambda x: x[good])
        fwd = [keep(_words(digit, z, False)[b : b + n]) for b, z in zip(begins, sizes, strict=True)]
        digit = digit ^ np.uint64(2)
        yield good + lo, fwd, [keep(_words(digit, z, True)[k - b - z :][:n]) for b, z in zip(begins, sizes, strict=True)]


def _whole(small: np.ndarray, k: int) -> np.ndarray:
    """Which windows have no other letter."""
    bad = np.append(np.int32(0), np.cumsum(small > 3, dtype=np.int32))
    return bad[k:] == bad[:-k]


def smaller(fwd: list[np.ndarray], rc: list[np.ndarray]) -> list[np.ndarray]:
    """The words of the smaller of each two k-mers."""
    less = rc[-1] < fwd[-1]
    if len(fwd) == 2:
        less = (rc[0] < fwd[0]) | (rc[0] == fwd[0]) & less
    return [np.where(less, y, x) for x, y in zip(fwd, rc, strict=True)]


def unpacked(k: int) -> Column:
    """The k-mer of the columns packed_columns(k)."""
    parts = [B.unpacked(F.col("packed"), min(k, WORD))]
    return F.concat(B.unpacked(F.col("packed_hi"), k - WORD), *parts) if k > WORD else parts[0]


#: Counted k-mers are dealt to 2**CELL_BITS cells by the first bits of a mixed word; a task holds the different ones of a cell, and
#: of what comes in at most HELD more.
CELL_BITS, HELD = 12, 1 << 23
#: A word is mixed by an odd factor, and comes back by that factor's inverse.
MIX, OTHER = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
BACK = pow(MIX, -1, 1 << 64)


def count(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """kmer, value: canonical k-mers that occur at least so often, with their number.  Below LONG bases they are sorted and counted per
    block of a task, shuffled in packed rows, one for each cell of a block, and merged cell by cell; from there on to 64 bases see
    _counted_in_runs; longer ones are counted as text."""
    if k > MOST:
        return enumerate_kmers(reads, k).select(B.canonical(F.col("fwd")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("value")).filter(F.col("value") >= least)
    if k >= LONG:
        return _counted_in_runs(reads, k, least)
    names = packed_columns(k)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in _joined(rows, BLOCK):
            for _, fwd, rc in windows(text, k):
                words = _mixed(smaller(fwd, rc))
                yield _celled(*_added(words, np.ones(len(words[0]), np.int64)))

    def merge_(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size = None, [], 0
        for batch in rows:
            for c, *parts in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if c != cell:
                    yield from _texts(held, k, least)
                    cell, held, size = c, [], 0
                held.append([*(np.frombuffer(x, "<u8") for x in parts[:-1]), np.frombuffer(parts[-1], "<i8")])
                size += len(held[-1][0])
                if size > HELD:
                    words, n = _merged(held)
                    held, size = [[*words, n]], 0
        yield from _texts(held, k, least)

    packed = reads.select(F.col("bases").cast("binary").alias("bases")).mapInArrow(run, ", ".join(["cell int", *(f"{c} binary" for c in names), "n binary"]))
    return packed.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge_, "kmer string, value long")


def _joined(rows: Iterator[pa.RecordBatch], block: int) -> Iterator[bytes]:
    """Texts of some `block` bytes or one longer one, with line ends between, across which no window goes."""
    held, size = [], 0
    for batch in rows:
        for text in batch.column(0).to_pylist():
            held.append(text or b"")
            size += len(held[-1]) + 1
            if size >= block:
                yield b"\n".join(held)
                held, size = [], 0
    yield b"\n".join(held)


#: From so many bases on, k-mers are shuffled as runs of windows with the same signature: their smallest mixed canonical k-mer of
#: SIGNATURE bases, which a reverse complement has too.  A run has at most RUN windows.
LONG, SIGNATURE, RUN = 16, 11, 255
#: A fixed value that hashes of runs are polynomials of, and its inverse.
BASE = 0x9FB21C651E98DF25
EASAB = pow(BASE, -1, 1 << 64)


def _counted_in_runs(reads: DataFrame, k: int, least: int) -> DataFrame:
    """kmer, value: neighbouring windows mostly share a signature, and so a cell: they are shuffled as the bases that they cover, two
    bits each, which takes a byte or so a window; equal runs of a block are shuffled once, with their number.  A task takes
    the windows of a cell's runs and counts them.  If a cell has more than HELD windows, it does so in several passes, each for a
    share of the k-mers: it holds the packed runs of a cell, and some HELD windows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in _joined(rows, BLOCK):
            digits = DIGITS[np.frombuffer(text, np.uint8)]
            for lo in range(0, max(0, len(digits) - k + 1), BLOCK):
                yield _runs(digits[lo : lo + BLOCK + k - 1], k)

    def merge_(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size = None, [], 0
        for batch in rows:
            for c, *parts in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if c != cell and size >= BLOCK:  # small cells are counted together
                    yield from _passes(held, k, least)
                    held, size = [], 0
                cell = c
                held.append(parts)
                size += len(parts[-1])
        yield from _passes(held, k, least)

    packed = reads.select(F.col("bases").cast("binary").alias("bases")).mapInArrow(run, "cell int, sizes binary, times binary, bases binary")
    return packed.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge_, "kmer string, value long")


def _signatures(small: np.ndarray, k: int) -> np.ndarray:
    """The cell of each window."""
    digit = (small & 3).astype(np.uint64)
    x = (np.minimum(_words(digit, SIGNATURE, False), _words(digit ^ np.uint64(2), SIGNATURE, True)) * np.uint64(MIX) >> np.uint64(32)).astype(np.uint32)
    x = x[: len(small) - SIGNATURE + 1]
    have, wide = 1, k - SIGNATURE + 1
    while have < wide:
        step = min(have, wide - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return (x.astype(np.uint64) * OTHER >> np.uint64(64 - CELL_BITS)).astype(np.int64)


@cache
def _powers(x: int, n: int) -> np.ndarray:
    return np.append(np.uint64(1), np.multiply.accumulate(np.full(n, x, np.uint64)))


def _runs(small: np.ndarray, k: int) -> pa.RecordBatch:
    """A row per cell with the windows of each of its different runs, how often they occur (nothing if all do once), and their
    bases, four in a byte; each run begins with a byte."""
    cell = np.where(_whole(small, k), _signatures(small, k), -1)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(first, append=len(cell))
    first, size = first[cell[first] >= 0], size[cell[first] >= 0]
    of, j = within(-(-size // RUN))
    first, size = first[of] + RUN * j, np.minimum(RUN, size[of] - RUN * j)
    most = BLOCK + MOST
    prefix = np.append(np.uint64(0), np.cumsum((small + np.uint64(1)) * _powers(BASE, most)[: len(small)]))
    key = (prefix[first + size + k - 1] - prefix[first]) * _powers(EASAB, most)[first]
    key = cell[first].astype(np.uint64) << np.uint64(64 - CELL_BITS) | key >> np.uint64(CELL_BITS)
    order = np.argsort(key)
    key, first, size = key[order], first[order], size[order]
    new = np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]))[: len(key)]
    same = np.flatnonzero(~new)
    if len(same):  # compared base by base
        of, j = within(size[same] + k - 1)
        new[same] = ~np.logical_and.reduceat(small[first[same][of] + j] == small[first[same - 1][of] + j], starts(size[same] + k - 1)[:-1])
    new = np.flatnonzero(new)
    times, first, size = np.diff(new, append=len(key)), first[new], size[new]
    cells, begins = np.unique(cell[first], return_index=True)
    begins = np.append(begins, len(first))
    quad, tail = np.append(small & 3, np.zeros(3, np.uint8)), len(small)
    quad = quad[:tail] << 6 | quad[1 : tail + 1] << 4 | quad[2 : tail + 2] << 2 | quad[3:]
    n = _quads(size, k)
    of, j = within(n)
    often = np.maximum.reduceat(times, begins[:-1]) > 1 if len(times) else np.zeros(0, bool)
    columns = [(size.astype(np.uint8), begins), (times[np.repeat(often, np.diff(begins))].astype("<u4"), starts(np.where(often, 4 * np.diff(begins), 0))), (quad[first[of] + 4 * j], starts(n)[begins])]
    binary = [pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(b.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x, b in columns]
    return pa.record_batch([pa.array(cells.astype(np.int32)), *binary], ["cell", "sizes", "times", "bases"])


def _quads(size: np.ndarray, k: int) -> np.ndarray:
    """Bytes of runs of so many windows."""
    return (size + k + 2) // 4


def _opened(rows: list[list[bytes]], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Canonical k-mers of the windows of runs, and how often each occurs."""
    sizes, times, bases = zip(*rows, strict=True)
    size = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
    often = np.ones(len(size), np.int64)
    if any(times):
        often = np.concatenate([np.frombuffer(x, "<u4") if x else np.ones(len(s), "<u4") for x, s in zip(times, sizes, strict=True)]).astype(np.int64)
    word = np.frombuffer(b"".join(bases) + bytes(24), np.uint8).astype(np.uint64)  # of 8 bytes from each byte on
    for n in (1, 2, 4):
        word = word[:-n] << np.uint64(8 * n) | word[n:]
    place = np.repeat(4 * starts(_quads(size, k))[:-1] - starts(size)[:-1], size) + np.arange(size.sum())

    def at(skip: int, n: int) -> np.ndarray:
        """The words of n bases from `skip` on."""
        if n > 29:  # with up to three bases before them they don't fit
            return at(skip, n - 16) << np.uint64(32) | at(skip + n - 16, 16)
        here = place + skip
        return word[here >> 2] << (here & 3).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - 2 * n)

    if k < WORD:
        fwd = at(0, k)
        return smaller([fwd], [_turned(fwd, k)]), np.repeat(often, size)
    fwd = [at(0, k - WORD) if k > WORD else np.zeros(len(place), np.uint64), at(k - WORD, WORD)]
    rc = [_turned(at(WORD, k - WORD), k - WORD) if k > WORD else fwd[0], _turned(at(0, WORD), WORD)]
    return smaller(fwd, rc), np.repeat(often, size)


def _turned(word: np.ndarray, n: int) -> np.ndarray:
    """The complements of words of n bases, reversed."""
    word = word.byteswap()
    for bits, some in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        word = word >> np.uint64(bits) & np.uint64(some) | (word & np.uint64(some)) << np.uint64(bits)
    return (word ^ np.uint64(0xAAAAAAAAAAAAAAAA)) >> np.uint64(64 - 2 * n)


def _passes(rows: list[list[bytes]], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """kmer, value of the runs of whole cells."""
    if not rows:
        return
    total = np.cumsum([int(np.frombuffer(x[0], np.uint8).sum(dtype=np.int64)) for x in rows])
    cuts = [*(np.flatnonzero(np.diff(total // BLOCK)) + 1).tolist(), len(rows)]
    passes = -(-int(total[-1]) // HELD)
    for share in range(passes):
        held = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            words, n = _opened(rows[lo:hi], k)
            if passes > 1:
                own = (_mixed(words)[-1] >> np.uint64(32)) % np.uint64(passes) == share
                words, n = [x[own] for x in words], n[own]
            held.append([*words, n])
        *words, n = map(np.concatenate, zip(*held, strict=True))
        yield from _spelled(*_summed(words, n), k, least)


def _summed(words: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """_added() in any order: single ones, of which there are most, are sorted without their numbers."""
    more = n > 1
    if len(words) == 2 or not more.any():
        return _added(words, n)
    (one,), n_one = _added([words[0][~more]], n[~more])
    (other,), n = _added([words[0][more]], n[more])
    at = np.searchsorted(one, other)
    there = (at < len(one)) & (np.append(one, np.uint64(0))[at] == other)
    n_one[at[there]] += n[there]
    return [np.append(one, other[~there])], np.append(n_one, n[~there])


def _mixed(words: list[np.ndarray]) -> list[np.ndarray]:
    last = words[-1] ^ words[0] * OTHER if len(words) == 2 else words[-1]
    return [*words[:-1], last * np.uint64(MIX)]


def _unmixed(words: list[np.ndarray]) -> list[np.ndarray]:
    last = words[-1] * np.uint64(BACK)
    return [*words[:-1], last ^ words[0] * OTHER if len(words) == 2 else last]


def _added(words: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different mixed k-mers in their order, and the sums of n."""
    if not len(n):
        return words, n
    even = len(words) == 1 and n.min() == n.max() == 1
    order = None if even else np.argsort(words[0]) if len(words) == 1 else np.lexsort(words)
    words = [np.sort(words[0])] if even else [x[order] for x in words]
    first = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in words], axis=0)))
    n = np.diff(first, append=len(n)) if even else np.add.reduceat(n[order], first)
    return [x[first] for x in words], n


def _merged(held: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    *words, n = map(np.concatenate, zip(*held, strict=True))
    return _added(words, n)


def _celled(words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    """A row per cell with the words and numbers of its k-mers as bytes."""
    bounds = np.searchsorted(words[-1], np.arange(1 << CELL_BITS, dtype=np.uint64) << np.uint64(64 - CELL_BITS))
    bounds = np.append(bounds, len(n))
    cells = np.flatnonzero(np.diff(bounds))
    offsets = pa.py_buffer((np.append(bounds[cells], len(n)) * 8).astype(np.int32))
    of = lambda x: pa.Array.from_buffers(pa.binary(), len(cells), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])
    return pa.record_batch([pa.array(cells.astype(np.int32)), *map(of, words), of(n.astype("<i8"))], ["cell", *packed_columns(MOST if len(words) == 2 else 1), "n"])


def _texts(held: list[list[np.ndarray]], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """kmer, value of one cell."""
    if not held:
        return
    words, n = _merged(held)
    yield from _spelled(_unmixed(words), n, k, least)


def _spelled(words: list[np.ndarray], n: np.ndarray, k: int, least: int) -> Iterator[pa.RecordBatch]:
    """kmer, value of counted k-mers that occur at least so often."""
    words, n = [x[n >= least] for x in words], n[n >= least]
    for lo in range(0, len(n), BLOCK // 16):
        some = [x[lo : lo + BLOCK // 16] for x in words]
        letters = np.empty((len(some[0]), k), np.uint8)
        for j in range(k):
            at = k - 1 - j
            letters[:, j] = np.frombuffer(b"ACTG", np.uint8)[(some[-1 - at // WORD] >> np.uint64(2 * (at % WORD)) & np.uint64(3)).astype(np.intp)]
        ends = pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32) * k)
        yield pa.record_batch([pa.Array.from_buffers(pa.string(), len(letters), [None, ends, pa.py_buffer(letters)]), pa.array(n[lo : lo + BLOCK // 16])], ["kmer", "value"])


def write(table: DataFrame, path: str, files: int = 64) -> None:
    """Sorted, range-partitioned files, so that footers skip."""
    table.repartitionByRange(files, "kmer").sortWithinPartitions("kmer").write.parquet(path)


def read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table as written; with first and last, only the k-mers between them in the order of text, which file footers prune."""
    table = spark.read.parquet(path)
    table = table.filter(F.col("kmer") >= first) if first else table
    return table.filter(F.col("kmer") <= last) if last else table


def merge(batches: DataFrame) -> DataFrame:
    """kmer, value, label of rows (batch, kmer, value, label): saturating sums, and the label of the first batch."""
    return batches.groupBy("kmer").agg(F.least(F.sum("value"), F.lit(SATURATED)).alias("value"), F.min_by("label", "batch").alias("label"))


def histogram(table: DataFrame) -> DataFrame:
    """value, occurrences; values of 0 don't count."""
    return table.filter("value > 0").groupBy("value").agg(F.count("*").alias("occurrences"))


def summary(table: DataFrame, k: int) -> DataFrame:
    """One row: unique, distinct, present, missing."""
    v = F.col("value")
    return table.filter("value > 0").agg(F.count_if(v == 1).alias("unique_kmers"), F.count("*").alias("distinct_kmers"), F.coalesce(F.sum(v), F.lit(0)).alias("present"), (F.lit(float(4**k)) - F.count("*")).alias("missing"))


def report(hist: DataFrame) -> DataFrame:
    """The histogram with running shares of distinct and of all k-mers.  It has a row per value, so at most sqrt(2 n) for n k-mers."""
    running = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, t = F.col("occurrences"), F.col("occurrences") * F.col("value")
    return hist.select("value", "occurrences", (F.sum(n).over(running) / F.sum(n).over(whole)).alias("distinct_share"), (F.sum(t).over(running) / F.sum(t).over(whole)).alias("total_share"))


def value_range(table: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """least <= value <= most, where 0 means 1 and no bound."""
    out = table.filter(F.col("value") >= max(1, least))
    return out.filter(F.col("value") <= most) if most else out


def range_report(table: DataFrame, least: int, most: int) -> DataFrame:
    v = F.col("value")
    return table.agg(F.count_if(v.between(least, most)).alias("loaded"), F.count_if(v < least).alias("too_low"), F.count_if(v > most).alias("too_high"))


def lookup_sizes(table: DataFrame, k: int, memory_bits: int = 1 << 38) -> DataFrame:
    """prefix_bits, bits, least, sparse: how many bits a lookup of table (kmer, value) takes, by the bits of its prefix.

    A prefix costs a 64-bit pointer, a k-mer its other bits and those of the greatest value.  `least` marks the
    smallest size, `sparse` the longest prefix within memory_bits that is less than 4 bits longer than that; it tells
    whether a table may be broadcast.  There are at most as many rows as a k-mer has bits; a table too small to have a
    prefix of 6 bits gives none.
    """
    n, p = F.col("n"), F.col("prefix_bits")
    most = F.least(F.length(F.bin("n")) + 1, F.lit(2 * k))
    whole = table.agg(F.count("*").alias("n"), F.coalesce(F.max("value"), F.lit(0)).cast("long").alias("top")).filter(most > 6)
    sizes = whole.withColumn("prefix_bits", F.explode(F.sequence(F.lit(6), most - 1)))
    value_bits = F.when(F.col("top") > 0, F.length(F.bin("top"))).otherwise(0)
    sizes = sizes.withColumn("bits", F.expr("shiftleft(1L, prefix_bits)") * 64 + n * (2 * k - p) + n * value_bits)
    every = Window.partitionBy("n")
    sizes = sizes.withColumn("best", F.min(F.struct("bits", "prefix_bits")).over(every)["prefix_bits"])
    sizes = sizes.withColumn("longest", F.max(F.when((F.col("bits") < memory_bits) & (p < F.col("best") + 4), p)).over(every))
    return sizes.select("prefix_bits", "bits", (p == F.col("best")).alias("least"), F.coalesce(p == F.col("longest"), F.lit(False)).alias("sparse"))


def exists(kmers: DataFrame, table: DataFrame) -> DataFrame:
    """Semi join on kmer; Spark broadcasts the table if statistics prove it small."""
    return kmers.join(table, "kmer", "left_semi")


def missing(kmers: DataFrame, table: DataFrame) -> DataFrame:
    return kmers.join(table, "kmer", "left_anti")


def value(kmers: DataFrame, table: DataFrame) -> DataFrame:
    """kmers with value, 0 if absent."""
    return kmers.join(table.select("kmer", "value"), "kmer", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def indexed(table: DataFrame) -> DataFrame:
    """table with idx, the dense rank of its k-mer: ranks within a first-six-bases cell, plus the cells before."""
    cell = F.substring("kmer", 1, 6)
    key = B.key(F.col("kmer"))
    rows = table.withColumn("_cell", B.key(cell))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")  # at most 4**6 rows
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    return rows.withColumn("_rank", rank).join(F.broadcast(offsets), "_cell").withColumn("idx", F.col("_before") + F.col("_rank")).drop("_cell", "_rank", "_before")


def packed_kmers(reads: DataFrame, k: int) -> DataFrame:
    """seq_idx, pos and the columns packed_columns(k): the canonical k-mer of every window of up to 64 bases without other letters."""
    names = packed_columns(k)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield from _placed(batch, k)

    ascii_ = F.regexp_replace("bases", r"[^\x00-\x7F]", "N").cast("binary")
    return reads.select(F.col("seq_idx").cast("long").alias("seq_idx"), ascii_.alias("bases")).mapInArrow(run, ", ".join(f"{c} long" for c in ["seq_idx", "pos", *names]))


def _placed(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The windows of a batch (seq_idx, bases), of some BLOCK bases of its sequences at once."""
    texts = [x or b"" for x in batch.column(1).to_pylist()]
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])
    cuts = [*np.unique(np.searchsorted(first, np.arange(0, first[-1], BLOCK))).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for at, fwd, rc in windows(b"\n".join(texts[a:b]), k):  # no window goes across a line's end
            row = np.searchsorted(first[a : b + 1] - first[a], at, side="right") - 1
            words = (pa.array(x.view(np.int64)) for x in smaller(fwd, rc))
            yield pa.record_batch([batch.column(0).take(pa.array(row + a)), pa.array(at - (first[a + row] - first[a])), *words], ["seq_idx", "pos", *packed_columns(k)])


def positions(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """query_idx, query_pos, seq_idx, pos, kmer wherever canonical k-mers (of up to 64 bases; longer ones raise) of both sides agree.

    Windows of a k-mer that many queries have are dealt to cells, to which the reference's are copied."""
    key = packed_columns(k)
    left = packed_kmers(queries, k).select(*key, F.col("seq_idx").alias("query_idx"), F.col("pos").alias("query_pos"))
    counts = left.groupBy(*key).agg(F.count("*").alias("n"))
    hot = skew.heavy_of(counts, key, counts.agg(F.sum("n")).first()[0] or 0)
    both = skew.dealt(left, hot, key, "query_idx", "query_pos").join(skew.copied(packed_kmers(reference, k), hot, key), [*key, "cell"])
    return both.select("query_idx", "query_pos", "seq_idx", "pos", unpacked(k).alias("kmer"))


def by_prefix(table: DataFrame, n: int) -> DataFrame:
    """prefix, n, total: how many k-mers begin with each n bases, and their values: what a table is divided by."""
    return table.groupBy(F.substring("kmer", 1, n).alias("prefix")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def space(spark, k: int) -> DataFrame:
    """All 4**k k-mers."""
    digits = [F.floor(F.col("id") / 4**j) % 4 for j in reversed(range(k))]
    return spark.range(4**k).select(F.translate(F.concat(*[d.cast("int").cast("string") for d in digits]), "0123", "ACTG").alias("kmer"))


def census(spark, k: int) -> DataFrame:
    m = F.col("kmer")
    return space(spark, k).agg(F.count_if(B.is_palindrome(m)).alias("palindromes"), F.count_if(B.key(m) < B.key(B.complement_reversed(m))).alias("below"))


#: The spread and reach of the smoothing.
SPREAD, WIDTH = 0.5, 9


def smoothed(hist: DataFrame, t: float = SPREAD, width: int = WIDTH) -> DataFrame:
    """Gaussian smoothing over neighbouring values up to width: each row is spread to its neighbours and summed."""
    import math

    weights = [math.exp(-(d * d) / (4 * t)) / math.sqrt(4 * math.pi * t) for d in range(-width, width + 1)]
    spread = F.explode(F.array(*[F.struct((F.col("value") + d).alias("v"), (F.col("occurrences") * w).alias("s")) for d, w in zip(range(-width, width + 1), weights, strict=True)]))
    return hist.select(spread.alias("x")).select("x.v", "x.s").groupBy(F.col("v").alias("value")).agg(F.sum("s").alias("smooth")).join(hist.select("value"), "value", "left_semi")


def extrema(curve: DataFrame) -> DataFrame:
    """value, smooth, kind of the local peaks and troughs of a curve (value, smooth), of any length: its stretches know the
    last row of the one before and the first of the one behind."""
    cells = ordered_cells(curve.withColumn("grp", F.lit(0)), "value")
    per, w = Window.partitionBy("grp").orderBy("cell"), Window.partitionBy("grp", "cell").orderBy("value")
    ends = cells.groupBy("grp", "cell").agg(F.min_by("smooth", "value").alias("first"), F.max_by("smooth", "value").alias("last"))
    ends = ends.select("grp", "cell", F.lag("last").over(per).alias("before"), F.lead("first").over(per).alias("behind"))
    near = cells.withColumns({"l": F.lag("smooth").over(w), "r": F.lead("smooth").over(w)}).join(ends, ["grp", "cell"])
    rise, go = F.col("smooth") - F.coalesce("l", "before"), F.coalesce("r", "behind") - F.col("smooth")
    kind = F.when((rise > 0) & (go < 0), "peak").when((rise < 0) & (go > 0), "trough")
    return near.withColumn("kind", kind).filter("kind is not null").select(*curve.columns, "kind")


#: Turning points are sought at values from FIRST to below REACH of a histogram cut at SPAN; at most PEAKS count.
FIRST, REACH, SPAN, PEAKS = 3, 100, 1024, 8


def turning_points(curve: DataFrame) -> DataFrame:
    """value, at, kind of the peaks and troughs of a curve (value, height) with a row for each whole value.

    Stretches of equal height count as one step, whose middle is the place; elsewhere the place is where the parabola
    through the step and its two neighbours turns.  All rows meet in one window: for curves of a bounded length.
    """
    w = Window.orderBy("value")
    steps = curve.withColumn("_old", F.lag("height").over(w)).filter("_old is null or _old <> height")
    h, left, right, stop = F.col("height"), F.lag("height").over(w), F.lead("height").over(w), F.lead("value").over(w)
    steps = steps.select("value", h, left.alias("l"), right.alias("r"), stop.alias("stop"))
    kind = F.expr("case when height > l and height > r then 'peak' when height < l and height < r then 'trough' end")
    at = F.expr("case when stop = value + 1 then value + (l - r) / (2 * (l - 2 * height + r)) else (value + stop - 1) / 2 end")
    return steps.select("value", at.cast("double").alias("at"), kind.alias("kind")).filter("kind is not null")


def peaks(hist: DataFrame, t: float = SPREAD, width: int = WIDTH) -> DataFrame:
    """peak, ploidy, coverage for peaks 1 to 8 of a histogram (value, occurrences), and as peak 0 the trough between noise and data.

    The trough is the first one of the histogram as it is, as smoothing would move it; peaks are those of the smoothed
    one.  Peak i has ploidy i, halved as often as peaks lie before the highest one.  What isn't there has coverage 0.
    Values from SPAN on have no effect, so that fewer than SPAN rows are fetched, once, and seen by windows; an empty
    histogram gives no row.
    """
    spark = hist.sparkSession
    small = hist.filter((F.col("value") >= 1) & (F.col("value") < SPAN)).groupBy("value").agg(F.sum("occurrences").cast("long").alias("occurrences"))
    small = spark.createDataFrame(small.collect(), "value long, occurrences long").coalesce(1)
    dense = spark.range(1, SPAN, numPartitions=1).select(F.col("id").alias("value")).join(small, "value", "left").select("value", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))
    near = F.col("value").between(FIRST, REACH - 1)
    raw = turning_points(dense.select("value", F.col("occurrences").cast("double").alias("height"))).filter(near & (F.col("kind") == "trough"))
    even = smoothed(dense, t, width).select("value", F.round("smooth", 6).alias("height"))  # rounded, so that no turn is a sum's last bit
    tops = turning_points(even).filter(near & (F.col("kind") == "peak")).withColumn("peak", F.row_number().over(Window.orderBy("value"))).filter(F.col("peak") <= PEAKS)
    found = tops.join(dense, "value").select("peak", "at", "occurrences").unionByName(raw.agg(F.min("at").alias("at")).select(F.lit(0).alias("peak"), "at", F.lit(-1).cast("long").alias("occurrences")))
    highest = found.agg(F.max(F.struct("occurrences", -F.col("peak"), F.col("peak").alias("top")))["top"].alias("top"))
    slots = spark.range(0, PEAKS + 1, numPartitions=1).select(F.col("id").cast("int").alias("peak"))
    rows = slots.join(found.select("peak", "at"), "peak", "left").crossJoin(F.broadcast(highest)).join(F.broadcast(small.limit(1).select(F.lit(1).alias("some"))))
    return rows.select("peak", (F.col("peak") / F.pow(F.lit(2.0), F.greatest(F.col("top"), F.lit(1)) - 1)).alias("ploidy"), F.coalesce("at", F.lit(0.0)).alias("coverage"))
