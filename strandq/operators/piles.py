"""Reads taken apart to the positions that they cover, many at a time: counted in packed rows before the one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of one packed row, and covered positions that are worked on at once.
BIN, AT_ONCE = 256, 1 << 21
VALID = "^([0-9]+[MIDNSHP=X])+$"
KINDS = pa.array(list("MIDNSHP=X"))
M, I, D, N, S, H, P, EQUAL, OTHER = range(9)  # noqa: E741
_KIND = np.zeros(256, np.int64)
_KIND[[ord(c) for c in KINDS.to_pylist()]] = range(9)


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of some stretches begins, and the end of the last."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all members of some stretches: the number of their stretch, and their place in it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - starts(sizes)[of]


def operations(cigars: pa.Array) -> tuple[np.ndarray, ...]:
    """The number of operations of each text of a column of valid cigars (null: none), and of each operation its text, its kind by its
    place in KINDS, and its length."""
    text = pc.fill_null(cigars, "")
    raw, ends = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8), np.cumsum(np.asarray(pc.binary_length(text)), dtype=np.int64)
    at = np.flatnonzero(raw >= 60)  # '=' and letters
    row = np.searchsorted(ends, at, side="right")
    digits = np.diff(at, prepend=-1) - 1
    of, k = within(digits)
    figures = (raw[np.repeat(at, digits) - digits[of] + k].astype(np.int64) - 48) * 10 ** np.minimum(digits[of] - 1 - k, 18)
    sums = starts(figures)[starts(digits)]
    return np.bincount(row, minlength=len(text)), row, _KIND[raw[at]], np.diff(sums)


def laid_out(cigars: pa.Array) -> tuple[np.ndarray, ...]:
    """What operations() says of a column of valid cigars, and of each operation where it begins in query and reference, and how many
    bases the insertions directly behind it have (padding and empty operations between don't part them)."""
    sizes, row, kind, n = operations(cigars)
    first = starts(sizes)
    begins = lambda kinds: (lambda c: c[:-1] - c[first[row]])(starts(np.where(np.isin(kind, kinds), n, 0)))
    added, inserted = starts(np.where(kind == I, n, 0)), np.zeros(len(n), np.int64)
    at = np.flatnonzero((kind != P) & (kind != I) & (n > 0))
    if len(at):
        until = np.append(at[1:], len(n))
        inserted[at] = added[np.minimum(until, first[row[at] + 1])] - added[at]
    return sizes, row, kind, n, begins([M, I, S, EQUAL, OTHER]), begins([M, D, N, EQUAL, OTHER]), inserted


def codes(column: pa.Array) -> np.ndarray:
    """Whole numbers that are equal where values of a column are; nulls have one of their own."""
    x = _told_apart(column).dictionary_encode()
    return np.asarray(pc.fill_null(x.indices, len(x.dictionary))).astype(np.int64)


def _told_apart(column: pa.Array) -> pa.Array:
    """A column that Arrow can number: nested values as texts."""
    return pa.array([None if x is None else repr(x) for x in column.to_pylist()], pa.string()) if pa.types.is_nested(column.type) else column


def even_zero(rows: DataFrame, name: str) -> DataFrame:
    """rows with 0.0 for -0.0 in a column, as Spark groups it."""
    return rows.withColumn(name, F.col(name) + F.lit(0.0).cast(dict(rows.dtypes)[name])) if dict(rows.dtypes)[name] in ("float", "double") else rows


def alike(columns: list[np.ndarray]) -> np.ndarray:
    """The number, from 0, of the group of each row that agrees with others in all of some columns of whole numbers."""
    order = np.lexsort(columns[::-1])
    new = np.any([np.diff(x[order]) != 0 for x in columns], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.append(0, np.cumsum(new))[: len(order)]
    return out


class _Letters:
    """The code points of a column of texts; 0 beyond a text's end, and for null ones."""

    def __init__(self, column: pa.Array) -> None:
        text = pc.fill_null(column, "")
        self.sizes = np.asarray(pc.utf8_length(text)).astype(np.int64)
        raw = "".join(text.to_pylist())
        self.all = np.frombuffer(raw.encode(), np.uint8) if raw.isascii() else np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.all = np.append(self.all, self.all.dtype.type(0))
        self.first = starts(self.sizes)[:-1]

    def at(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        there = (place >= 0) & (place < self.sizes[row])
        return self.all[np.where(there, self.first[row] + place, -1)]


def _narrow(x: np.ndarray, wide: type) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else wide)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: the bytes of values between each two bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, sizes: np.ndarray, wide: type) -> np.ndarray:
    """What _blobs put there, of rows that may differ in the width of a number."""
    narrow = np.asarray(pc.binary_length(column)) == sizes
    if narrow.all():
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(wide)
    return np.concatenate([np.frombuffer(x, np.uint8 if n else wide).astype(wide) for x, n in zip(column.to_pylist(), narrow, strict=True)])


PACKED = "bin long, inserted string, place binary, base binary, mark binary, n binary"


def _packed(table: pa.Table, keys: list[str], behind: bool) -> pa.RecordBatch:
    """Rows of keys, bin, inserted, and lists of place, base, mark and number, of reads (keys, pos, cigar, seq, qual)."""
    table = table.combine_chunks()
    col = {c: (x.chunk(0) if x.num_chunks else pa.array([], x.type)) for c, x in zip(table.column_names, table.columns, strict=True)}
    _, row, kind, n, a, b, inserted = laid_out(col["cigar"])
    nowhere = np.asarray(pc.is_null(col["pos"]))
    b = b + np.asarray(pc.fill_null(col["pos"], 0)).astype(np.int64)[row]
    lost, take = kind == D, np.isin(kind, [M, D, EQUAL, OTHER]) & (n > 0)
    # Of each operation the place, length, place in the query, that of its first quality, and how many bases are behind it.
    ops = np.stack([row, b, n, a, np.where(lost, a - 1, a), lost, np.zeros_like(n)])[:, take]
    if behind:
        more = inserted[take] > 0
        last = ops[:, more].copy()
        step = last[2] - 1
        last[1], last[3], last[4], last[2], last[6] = last[1] + step, last[3] + np.where(last[5], 0, step), last[4] + np.where(last[5], 0, step), 1, inserted[take][more]
        ops[2] -= more
        ops = np.concatenate([ops, last], axis=1)
        ops = ops[:, ops[2] > 0]
    row, b, n, a, m, lost, added = ops
    # Cut where bins end.
    of, k = within((b + n - 1) // BIN - b // BIN + 1)
    bins = b[of] // BIN + k
    lo, hi = np.maximum(b[of], bins * BIN), np.minimum((b + n)[of], (bins + 1) * BIN)
    row, lost, added, skip = row[of], lost[of] > 0, added[of], lo - b[of]
    a, m = a[of] + np.where(lost, 0, skip), m[of] + np.where(lost, 0, skip)
    bins[nowhere[row]] = 0
    seq, text = _Letters(col["seq"]), pa.nulls(len(row), pa.string())
    if behind and added.any():
        cut = col["seq"].to_pylist()
        shown = np.full(len(row), None, object)
        for i in np.flatnonzero(added):
            s, at = cut[row[i]], int(a[i]) + (0 if lost[i] else 1)
            shown[i] = None if s is None else s[at : at + int(added[i])]
        text = pa.array(shown, pa.string())
    key = alike([codes(col[c])[row] for c in keys] + [nowhere[row].astype(np.int64), bins, codes(text)])
    # All positions.
    of, k = within(hi - lo)
    place = (lo % BIN)[of] + k
    place[nowhere[row[of]]] = 0
    base = np.where(lost[of], ord("-"), seq.at(row[of], a[of] + k)).astype(np.int64)
    mark = _Letters(col["qual"]).at(row[of], m[of] + np.where(lost[of], 0, k)).astype(np.int64)
    bases, base = np.unique(base, return_inverse=True)
    marks, mark = np.unique(mark, return_inverse=True)
    each, count = np.unique(((key[of] * BIN + place) * len(bases) + base) * len(marks) + mark, return_counts=True)
    each, mark = np.divmod(each, len(marks)) if len(each) else (each, each)
    each, base = np.divmod(each, len(bases)) if len(each) else (each, each)
    group, place = np.divmod(each, BIN)
    bounds = starts(np.bincount(group, minlength=key.max() + 1 if len(key) else 0))
    first = np.zeros(len(bounds) - 1, np.int64)
    first[key[::-1]] = np.arange(len(key))[::-1]
    where = pa.array(row[first])
    own = [*(col[c].take(where) for c in keys), pa.array(bins[first], mask=nowhere[row[first]]), text.take(pa.array(first))]
    own += [_blobs(x, bounds) for x in (place.astype(np.uint8), _narrow(bases[base], np.uint32), _narrow(marks[mark], np.uint32), _narrow(count, np.int64))]
    return pa.record_batch(own, [*keys, "bin", "inserted", "place", "base", "mark", "n"])


def entries(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, ...]:
    """The row, place, base, mark and number of each entry of packed rows."""
    sizes = np.asarray(pc.binary_length(table["place"])).astype(np.int64)
    joined = {c: table[c].combine_chunks() for c in ("place", "base", "mark", "n")}
    return (np.repeat(np.arange(len(sizes)), sizes), *(_values(joined[c], sizes, w).astype(np.int64) for c, w in (("place", np.uint8), ("base", np.uint32), ("mark", np.uint32), ("n", np.int64))))


def _flat(table: pa.Table, columns: list[str]) -> list[pa.Array]:
    return [table[c].combine_chunks() for c in columns]


def summed(each: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different values of each, in order, with sums of weights."""
    order = np.argsort(each, kind="stable")
    each = each[order]
    first = np.flatnonzero(np.append(True, each[1:] != each[:-1])) if len(each) else order
    return (each[first], *(np.add.reduceat(w[order], first) if len(each) else w for w in weights))


def _compact(table: pa.Table, keys: list[str]) -> pa.Table:
    """Packed rows with the same keys, bin and inserted as one."""
    group = alike([codes(x) for x in _flat(table, [*keys, "bin", "inserted"])])
    row, place, base, mark, n = entries(table, keys)
    bases, base = np.unique(base, return_inverse=True)
    marks, mark = np.unique(mark, return_inverse=True)
    each, n = summed(((group[row] * BIN + place) * len(bases) + base) * len(marks) + mark, n)
    each, mark = np.divmod(each, len(marks))
    each, base = np.divmod(each, len(bases))
    own, place = np.divmod(each, BIN)
    bounds = starts(np.bincount(own, minlength=group.max() + 1))
    first = np.zeros(len(bounds) - 1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    where = pa.array(first)
    blobs = [_blobs(x, bounds) for x in (place.astype(np.uint8), _narrow(bases[base], np.uint32), _narrow(marks[mark], np.uint32), _narrow(n, np.int64))]
    return pa.table([*(x.take(where) for x in _flat(table, [*keys, "bin", "inserted"])), *blobs], names=table.column_names)


def counted(rows: DataFrame, keys: list[str], apart: list[str], finish: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, behind: bool = True) -> DataFrame:
    """What `finish` makes of the entries of all reads of rows (chrom, pos, cigar, seq, qual, and the columns of keys and apart).

    A task takes about AT_ONCE positions apart, counts those that agree, and packs them, one row for each value of all these columns and
    bin of BIN positions.  Packed rows are shuffled and sorted by keys and bin; finish gets all rows of some of these, and is
    called for as many as hold about AT_ONCE entries.  If one bin has more they are counted together: its memory is that of
    its different entries, however deep it is.
    """
    some = [*keys, *apart]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, row, kind, n = operations(batch.column(len(some) + 1))
            total = np.cumsum(np.bincount(row, np.where(np.isin(kind, [M, D, EQUAL, OTHER]), n, 0), minlength=len(sizes)).astype(np.int64))
            cuts = [*(np.flatnonzero(np.diff(total // AT_ONCE)) + 1).tolist(), batch.num_rows]
            lo = 0
            for hi in cuts:
                held.append(batch.slice(lo, hi - lo))
                size += int(total[hi - 1] - (total[lo - 1] if lo else 0))
                lo = hi
                if size >= AT_ONCE:
                    yield _packed(pa.Table.from_batches(held), some, behind)
                    held, size = [], 0
        if held:
            yield _packed(pa.Table.from_batches(held), some, behind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, AT_ONCE
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(np.asarray(pc.binary_length(batch.column(len(some) + 2))).sum())
            if size < limit:
                continue
            table = pa.Table.from_batches(held)
            group = np.stack([codes(x) for x in _flat(table, [*keys, "bin"])])
            change = np.flatnonzero(np.any(group[:, 1:] != group[:, :-1], axis=0))
            if len(change):
                cut = int(change[-1]) + 1
                yield from done(table.slice(0, cut))
                table = table.slice(cut)
            table = _compact(table, some)
            held = table.to_batches()
            size = int(np.asarray(pc.binary_length(table["place"])).sum())
            limit = max(AT_ONCE, 2 * size)
        if held:
            yield from done(pa.Table.from_batches(held))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = alike([codes(x) for x in _flat(table, [*keys, "bin"])])
        for x in finish(table, group).to_batches(max_chunksize=1 << 16):
            yield x

    kinds = dict(rows.select(*some).dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in some)
    reads = rows.select(*some, F.col("pos").cast("long").alias("pos"), "cigar", F.col("seq").cast("string").alias("seq"), F.col("qual").cast("string").alias("qual")).filter(F.col("cigar").rlike(VALID))
    packed = reads.mapInArrow(pack, f"{own}, {PACKED}")
    return packed.repartition(*keys, "bin").sortWithinPartitions(*keys, "bin").mapInArrow(merge, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), schema]))


def pileup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, base, inserted, n, quality: see sequences.pileup."""

    def finish(table: pa.Table, group: np.ndarray) -> pa.Table:
        own = alike([group, codes(table["inserted"].combine_chunks())])
        row, place, base, mark, n = entries(table, keys)
        bases, base = np.unique(base, return_inverse=True)
        known = np.where(mark > 0, n, 0)
        each, n, known, quality = summed((own[row] * BIN + place) * max(1, len(bases)) + base, n, known, known * (mark - 33))
        each, base = np.divmod(each, max(1, len(bases)))
        own_of, place = np.divmod(each, BIN)
        first = np.zeros(own.max() + 1, np.int64)
        first[own[::-1]] = np.arange(len(own))[::-1]
        where = pa.array(first[own_of])
        column = {c: table[c].combine_chunks() for c in [*keys, "bin", "inserted"]}
        letters = pa.array([chr(c) if c else None for c in bases.tolist()], pa.string()).take(pa.array(base))
        pos = pc.add(pc.multiply(column["bin"].take(where), BIN), pa.array(place))
        return pa.table([*(column[c].take(where) for c in keys), pos, letters, column["inserted"].take(where), pa.array(n), pa.array(quality, mask=known == 0)], names=[*keys, "pos", "base", "inserted", "n", "quality"])

    return counted(rows, keys, [], finish, "pos long, base string, inserted string, n long, quality long")


#: Reads of one task of column_sums, at most about so many, and of them those that are worked on at once.
READS, READS_AT_ONCE = 1 << 20, 1 << 15


def column_sums(rows: DataFrame) -> DataFrame:
    """id, op, n, sum_a, sum_b, sum_ab: see sequences.column_sums.

    Reads are dealt by id as they are, since an id with its sums is several times as long, and sorted by it within tasks, whose
    number grows with the reads.  A read's sums come from where its operations begin and how long they are; those of one
    id are added at once, or if there are very many, as they come."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, carried = [], 0, None
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < READS_AT_ONCE:
                continue
            sums = _column_sums(pa.Table.from_batches(held), carried)
            held, size = [], 0
            if sums.num_rows:
                cut = int(np.searchsorted(code := _in_turn(sums["id"].combine_chunks()), code[-1]))  # the last id may go on
                yield from sums.slice(0, cut).to_batches()
                carried = sums.slice(cut)
        if held or carried is not None:
            yield from (_column_sums(pa.Table.from_batches(held), carried) if held else carried).to_batches()

    reads = rows.select("id", "cigar", F.col("pos").cast("long").alias("pos")).filter(F.col("cigar").rlike(VALID))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // READS))
    dealt = even_zero(reads, "id").repartition(tasks, "id").sortWithinPartitions("id")
    return dealt.mapInArrow(run, f"id {kind}, op string, n long, sum_a long, sum_b long, sum_ab long")


def _in_turn(column: pa.Array) -> np.ndarray:
    """codes() in the order in which values first come, null like any other."""
    return np.asarray(_told_apart(column).dictionary_encode(null_encoding="encode").indices).astype(np.int64)


def _column_sums(reads: pa.Table, before: pa.Table | None) -> pa.Table:
    """id, op and sums of reads (id, cigar, pos) in their order of ids, with rows of the same kind added to the first ones."""
    reads = reads.combine_chunks()
    col = {c: reads[c].combine_chunks() for c in ("id", "cigar", "pos")}
    _, row, kind, n, a, b, _ = laid_out(col["cigar"])
    some = np.isin(kind, [M, I, D, EQUAL, OTHER]) & (n > 0)
    row, kind, n, a, b = (x[some] for x in (row, kind, n, a, b))
    in_a, in_b = kind != D, (kind != I) & ~np.asarray(pc.is_null(col["pos"]))[row]
    b = b + np.asarray(pc.fill_null(col["pos"], 0)).astype(np.int64)[row]
    # Of n columns from a and b on: 0 + 1 + ... and the squares of these.
    once = n * (n - 1) // 2
    twice = np.where(once % 3 == 0, once // 3 * (2 * n - 1), once * ((2 * n - 1) // 3))
    sums = [n, n * a + once, n * b + once, n * a * b + (a + b) * once + twice]
    x, y, z = n.astype(float), a.astype(float), np.abs(b.astype(float))
    most = x * y * z + (y + z) * x * x / 2 + x * x * x / 3
    ids, known = col["id"].take(pa.array(row)), [np.ones(len(n), bool), in_a, in_b, in_a & in_b]
    if before is not None:
        ids = pa.concat_arrays([before["id"].combine_chunks(), ids])
        kind = np.append(np.asarray(pc.index_in(before["op"].combine_chunks(), KINDS)).astype(np.int64), kind)
        old = [before[c].combine_chunks() for c in before.column_names[2:]]
        known = [np.append(np.asarray(pc.is_valid(x)), k) for x, k in zip(old, known, strict=True)]
        sums = [np.append(np.asarray(pc.fill_null(x, 0)).astype(np.int64), y) for x, y in zip(old, sums, strict=True)]
        most = np.append(np.abs(sums[-1][: len(before)].astype(float)), most)
    code = _in_turn(ids)
    each, most, *added = summed(code * len(KINDS) + kind, most, *(np.where(k, x, 0) for k, x in zip(known, sums, strict=True)), *(k.astype(np.int64) for k in known))
    if len(most) and most.max() >= 2.0**63:
        raise OverflowError("sums of an operation's positions don't fit 64 bits")
    first = np.full(len(ids), -1)
    first[code[::-1]] = np.arange(len(ids))[::-1]
    of, op = np.divmod(each, len(KINDS))
    values = [pa.array(x, mask=k == 0) for x, k in zip(added[: len(sums)], added[len(sums) :], strict=True)]
    return pa.table([ids.take(pa.array(first[of])), KINDS.take(pa.array(op)), *values], names=["id", "op", "n", "sum_a", "sum_b", "sum_ab"])
