"""Intervals [bgn, end_) per group grp.  Sweeps run within stretches of coordinates, and small windows carry over between them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import skew, stats
from .packed import numbers, packed
from .piles import codes, even_zero, starts
from .stats import apart, ordered_cells, tasks_of

#: Each size of bins is so many times the one before.
STEP = 8


def from_span(rows: DataFrame, at: str, length: str) -> DataFrame:
    """bgn, end_ of a start and a length; a negative length lies before the start."""
    a, b = F.col(at), F.col(at) + F.col(length)
    return rows.withColumns({"bgn": F.least(a, b), "end_": F.greatest(a, b)})


def of_length(rows: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Intervals of at least and at most so many positions, both included."""
    n = F.col("end_") - F.col("bgn")
    return rows.filter((n >= least) & (F.lit(True) if most is None else n <= most))


def region_list(regions: DataFrame) -> DataFrame:
    """grp, bgn, end_, num of texts (region) such as 'chr:beg-end', merged where they overlap; an open end is the greatest number."""
    r = parse_region(F.col("region"))
    return squash(regions.select(r["name"].alias("grp"), r["beg"].alias("bgn"), F.coalesce(r["end"], F.lit(2**63 - 1)).alias("end_")))


def squash(rows: DataFrame, min_overlap: int = 0) -> DataFrame:
    """grp, bgn, end_, num: intervals that overlap by min_overlap, or are contained, become one.

    Groups are dealt to stretches of bgn.  What reaches into a stretch is the greatest end of those before it, and an
    interval that began there goes on in those that don't begin one: both are carried over a row per stretch."""
    cells = ordered_cells(rows.select("grp", "bgn", "end_"), "bgn")
    before, within = Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("grp", "cell").orderBy("bgn", "end_")
    ends = cells.groupBy("grp", "cell").agg(F.max("end_").alias("most")).select("grp", "cell", F.max("most").over(before).alias("carried"))
    own = apart(cells).join(ends, ["grp", "cell"])
    reach = F.greatest(F.max("end_").over(within.rowsBetween(Window.unboundedPreceding, -1)), "carried")
    own = own.withColumn("fresh", F.when((reach >= F.col("bgn") + min_overlap) | (F.col("end_") <= reach), 0).otherwise(1))
    own = own.withColumn("nth", F.sum("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = own.groupBy("grp", "cell", "nth").agg(F.min("bgn").alias("bgn"), F.max("end_").alias("end_"), F.count("*").alias("num"))
    # Part 0 of a stretch began in an earlier one: it belongs to the last part of the one before that has any.
    last = parts.groupBy("grp", "cell").agg(F.max("nth").alias("last"))
    last = last.select("grp", "cell", F.max(F.when(F.col("last") > 0, F.struct("cell", "last"))).over(before).alias("from"))
    home = F.when(F.col("nth") > 0, F.struct("cell", F.col("nth").alias("last"))).otherwise(F.col("from"))
    whole = parts.join(last, ["grp", "cell"]).select("grp", home.alias("home"), "bgn", "end_", "num").repartition(tasks_of(cells), "grp", "home")
    return whole.groupBy("grp", "home").agg(F.min("bgn").alias("bgn"), F.max("end_").alias("end_"), F.sum("num").alias("num")).drop("home")


def depth(rows: DataFrame) -> DataFrame:
    """grp, bgn, end_, depth between each two neighbouring coordinates; gaps have depth 0.

    Coordinates are dealt to stretches, whose sums and first coordinates are carried over a row per stretch."""
    events = rows.select("grp", F.explode(F.array(F.struct(F.col("bgn").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end_").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    sums = ordered_cells(events.groupBy("grp", "e.pos").agg(F.sum("e.d").alias("d")), "pos", 2 * rows.count())
    per = Window.partitionBy("grp").orderBy("cell")
    cells = sums.groupBy("grp", "cell").agg(F.sum("d").alias("all"), F.min("pos").alias("first"))
    cells = cells.select("grp", "cell", F.coalesce(F.sum("all").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"), F.lead("first").over(per).alias("next"))
    w = Window.partitionBy("grp", "cell").orderBy("pos")
    own = apart(sums).withColumns({"stop": F.lead("pos").over(w), "own": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(cells, ["grp", "cell"])
    return own.select("grp", F.col("pos").alias("bgn"), F.coalesce("stop", "next").alias("end_"), (F.col("own") + F.col("carried")).alias("depth")).filter("end_ is not null")


def invert(squashed: DataFrame, lo: int, hi: int) -> DataFrame:
    """The holes of squashed intervals within [lo, hi), clipped to it; dealt to stretches like the others."""
    cells = ordered_cells(squashed.select("grp", "bgn", "end_"), "bgn")
    per, w = Window.partitionBy("grp").orderBy("cell"), Window.partitionBy("grp", "cell").orderBy("bgn")
    ends = cells.groupBy("grp", "cell").agg(F.max("end_").alias("most")).select("grp", "cell", F.lag("most").over(per).alias("carried"))
    gaps = apart(cells).withColumn("was", F.lag("end_").over(w)).join(ends, ["grp", "cell"]).select("grp", F.coalesce("was", "carried", F.lit(lo)).alias("bgn"), F.col("bgn").alias("end_"))
    last = squashed.groupBy("grp").agg(F.max("end_").alias("bgn")).select("grp", "bgn", F.lit(hi).alias("end_"))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)).cast("long").alias(c)
    return gaps.unionByName(last).select("grp", clip("bgn"), clip("end_")).filter("bgn < end_")


def invert_each(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """The up to two holes that each interval alone leaves in [lo, hi)."""
    holes = F.array(F.struct(F.lit(lo).cast("long").alias("bgn"), F.col("bgn").cast("long").alias("end_")), F.struct(F.col("end_").cast("long").alias("bgn"), F.lit(hi).cast("long").alias("end_")))
    return rows.select("grp", F.explode(holes).alias("h")).select("grp", "h.bgn", "h.end_").filter("bgn < end_")


def overlaps(left: DataFrame, right: DataFrame, width: int, closed: bool = False) -> DataFrame:
    """Pairs of overlapping rows of left (grp, bgn, end_, ...) and right (grp, beg2, end2, ...).

    Bins of `width`, eight times that, and so on: an interval lies in at most two bins of its own size.  Two intervals meet
    in the bins of the larger one's size; so each is dealt to the bins of its size and of the larger sizes that the other
    side has, and a pair counts in the first bin that both share.  However long an interval is, its rows are few.  Bins that
    very many intervals of left lie in are dealt to cells, to which those of right are copied.
    """
    last = (lambda e: F.col(e)) if closed else (lambda e: F.greatest(F.col(e) - 1, F.lit(0)))
    size = lambda b, e: F.greatest(F.ceil(F.log(F.greatest(last(e) - F.col(b) + 1, F.lit(1)) / width) / math.log(STEP)), F.lit(0)).cast("int")
    a, b = left.withColumn("_own", size("bgn", "end_")), right.withColumn("_own2", size("beg2", "end2"))
    sizes = lambda x, c: [r[0] for r in x.select(c).distinct().collect()]  # noqa: E731  of 64-bit numbers there are 22
    bins = lambda b, e: F.sequence(F.expr(f"floor({b} / ({width}L * power({STEP}, _size)))").cast("long"), F.greatest(F.floor(F.col(b) / (width * F.pow(F.lit(STEP), F.col("_size")))), F.floor(last(e) / (width * F.pow(F.lit(STEP), F.col("_size"))))))

    def dealt(x, own, other, begin, end):
        which = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda s: s > F.col(own))))
        return x.withColumn("_size", F.explode(which)).withColumn("_bin", F.explode(bins(begin, end)))

    x, y = dealt(a, "_own", sizes(b, "_own2"), "bgn", "end_"), dealt(b, "_own2", sizes(a, "_own"), "beg2", "end2")
    meet = "bgn <= end2 and end_ >= beg2" if closed else "bgn < end2 and end_ > beg2"
    key = ["grp", "_size", "_bin"]
    counts = x.groupBy(*key).agg(F.count("*").alias("n"))
    hot = skew.heavy_of(counts, key, left.count())
    pairs = skew.dealt(x, hot, key, *left.columns).join(skew.copied(y, hot, key), [*key, "cell"]).filter(meet).filter("_size = greatest(_own, _own2)")
    first = F.floor(F.greatest("bgn", "beg2") / (width * F.pow(F.lit(STEP), F.col("_size"))))
    return pairs.filter(F.col("_bin") == first).drop("_bin", "_size", "_own", "_own2", "cell")


def touching(left: DataFrame, regions: DataFrame, width: int, keep: bool = True, by: str = "overlap") -> DataFrame:
    """Rows of left (with a unique column id) that touch some region, or none of them: by overlap, by their start alone, or by the
    change that they make (with columns ref and alts).

    A change begins behind what the reference and all alleles have in common at their front; it ends with the reference.
    One that only inserts lies between two positions, both of which must be in the region."""
    rows = left
    if by == "start":
        rows = left.withColumn("end_", F.col("bgn") + 1)
    elif by == "change":
        rows = left.withColumns({"bgn": F.col("bgn") + common_front(F.col("ref"), F.col("alts")), "end_": F.col("bgn") + F.length("ref")})
    return left.join(overlaps(rows, regions, width).select("id").distinct(), "id", "left_semi" if keep else "left_anti")


def common_front(ref: Column, alts: Column) -> Column:
    """How many bases a reference allele and all others have in common at their front; all of the reference without others."""

    def front(alt: Column) -> Column:
        n = F.least(F.length(ref), F.length(alt))
        differ = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ref.substr(i, F.lit(1)) == alt.substr(i, F.lit(1))), F.lit(False))
        return F.when(differ > 0, differ - 1).otherwise(n).cast("int")

    return F.aggregate(F.coalesce(alts, F.array().cast("array<string>")), F.length(ref), lambda a, alt: F.least(a, front(alt)))


#: Which positions an operation keeps, of those that are in some interval of either list, by its name.
OPERATIONS = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "either": lambda a, b: a != b}
#: Intervals that are packed at once, and how many positions of a sample a stretch has.
PACK, SAMPLE = 1 << 19, 128


def combined(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """grp, bgn, end_: the positions of an operation of OPERATIONS on two lists of intervals (grp, bgn, end_), as the fewest
    intervals.  Intervals of a list may overlap; empty ones, and those with a null, have no positions.

    Where intervals begin and end is shuffled once, in packed rows in which what falls on one place is summed.  A task sorts
    all of a cell and finds its intervals.  A cell has all of many groups, or a stretch of a group that has too many for one
    task: for such groups sums are carried over the stretches before, and intervals that reach over a stretch's bounds
    are put together of one piece per stretch.  A sample says where to cut, and nothing else."""
    side = lambda rows, x: rows.select("grp", F.col("bgn").cast("long").alias("bgn"), F.col("end_").cast("long").alias("end_"), F.lit(x).alias("in_a")).filter("grp is not null and bgn < end_")
    both, total = even_zero(side(a, True).unionByName(side(b, False)), "grp"), a.count() + b.count()
    n = stats.stretches(2 * total, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = _large(both, total, n)
    cuts, base = {}, 0
    for grp, cut in large:
        cuts[base] = np.array(cut, np.int64)
        base += len(cut) + 1
    cell = F.lit(base) + F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int")
    if large:
        of = both.sparkSession.createDataFrame([(x[0], c) for x, c in zip(large, cuts, strict=True)], both.select("grp", F.lit(0).alias("base")).schema)
        both, cell = both.join(F.broadcast(of), "grp", "left"), F.coalesce("base", cell)
    both = both.select("grp", cell.alias("cell"), "bgn", "end_", "in_a")
    carried = _carried(both.filter(F.col("cell") < base), cuts) if large else {}
    kind = f"grp {dict(both.dtypes)['grp']}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _some(batches, PACK):
            yield _ends_packed(table, cuts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            own = np.asarray(batch.column(0))
            bounds = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            for lo, hi in zip(bounds, np.append(bounds[1:], len(own)), strict=True):
                if own[lo] != cell:
                    yield from found(cell, held)
                    cell, held = own[lo], []
                held.append(batch.slice(lo, hi - lo))
        yield from found(cell, held)

    def found(cell: int | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from _pieces(pa.Table.from_batches(held), int(cell), carried.get(int(cell), (0, 0)), bounds_of.get(int(cell)), OPERATIONS[operation]).to_batches(max_chunksize=1 << 16)

    bounds_of = {c + i: (cut[i - 1] if i else None, cut[i] if i < len(cut) else None) for c, cut in cuts.items() for i in range(len(cut) + 1)}
    rows = both.mapInArrow(pack, f"cell int, grps array<{kind[4:]}>, sizes binary, pos binary, a binary, b binary")
    pieces = rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(find, f"{kind}, cell int, bgn long, end_ long, open boolean, goes_on boolean")
    if not large:
        return pieces.select("grp", "bgn", "end_")
    pieces = materialise(pieces)
    chain = F.sum(F.when(F.col("open"), 0).otherwise(1)).over(Window.partitionBy("grp").orderBy("cell", "bgn"))
    joined = pieces.filter("open or goes_on").withColumn("chain", chain).groupBy("grp", "chain").agg(F.min("bgn").alias("bgn"), F.max("end_").alias("end_"))
    return pieces.filter("not (open or goes_on)").select("grp", "bgn", "end_").unionByName(joined.select("grp", "bgn", "end_"))


def _large(both: DataFrame, total: int, n: int) -> list[tuple]:
    """Groups that have more than about a quarter of a stretch, and where to cut them: at most some 4 n places."""
    share = min(1.0, SAMPLE * n / max(1, 2 * total))
    most = max(1, int(max(2 * total // (4 * n), stats.STRETCH // 64) * share))
    spots = both.sample(share, seed=1) if share < 1 else both
    places = spots.select("grp", F.explode(F.array("bgn", "end_")).alias("pos")).groupBy("grp").agg(F.sort_array(F.collect_list("pos")).alias("s")).filter(F.size("s") > most)
    parts = f"cast(ceil(size(s) / {most}) as int)"
    cut = F.expr(f"array_sort(array_distinct(transform(sequence(1, {parts} - 1), i -> s[cast(i * cast(size(s) as long) div {parts} as int)])))")
    return [(r[0], r[1]) for r in places.select("grp", cut).collect()]


def _some(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _ends(table: pa.Table, cuts: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The row, cell, position and changes of both lists where intervals (cell, bgn, end_, in_a) begin and end."""
    cell, bgn, end, in_a = (np.asarray(table[c].combine_chunks()) for c in ("cell", "bgn", "end_", "in_a"))
    row, pos = np.tile(np.arange(len(cell)), 2), np.append(bgn, end)
    move = np.repeat(np.array([1, -1]), len(cell))
    cell = np.tile(cell, 2).astype(np.int64)
    if cuts:
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
        for lo, hi, c in zip(first, np.append(first[1:], len(order)), cell[order[first]].tolist(), strict=True):
            if c in cuts:
                cell[order[lo:hi]] += np.searchsorted(cuts[c], pos[order[lo:hi]], side="right")
    in_a = np.tile(in_a, 2)
    return row, cell, pos, np.where(in_a, move, 0), np.where(in_a, 0, move)


def _carried(rows: DataFrame, cuts: dict[int, np.ndarray]) -> dict[int, tuple[int, int]]:
    """How many intervals of both lists are open where each stretch of the large groups begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _some(batches, PACK):
            _, cell, _, a, b = _ends(table, cuts)
            cells, at = np.unique(cell, return_inverse=True)
            sums = [pa.array(np.bincount(at, x, len(cells)).astype(np.int64)) for x in (a, b)]
            yield pa.record_batch([pa.array(cells.astype(np.int32)), *sums], ["cell", "a", "b"])

    sums = {r[0]: (r[1], r[2]) for r in rows.mapInArrow(run, "cell int, a long, b long").groupBy("cell").agg(F.sum("a"), F.sum("b")).collect()}
    out = {}
    for base, cut in cuts.items():
        a = b = 0
        for c in range(base, base + len(cut) + 1):
            out[c] = a, b
            a, b = a + sums.get(c, (0, 0))[0], b + sums.get(c, (0, 0))[1]
    return out


def _summed(group: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first row, group, position and sums of changes of each place at which these aren't 0, in order."""
    order = np.lexsort((pos, group))
    group, pos = group[order], pos[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (pos[1:] != pos[:-1]))[: len(pos)])
    a, b = np.add.reduceat(a[order], first), np.add.reduceat(b[order], first)
    some = (a != 0) | (b != 0)
    first = first[some]
    return order[first], group[first], pos[first], a[some], b[some]


def _ends_packed(table: pa.Table, cuts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A row per cell with its groups, how many places each has, and these places with the changes of both lists."""
    row, cell, pos, a, b = _ends(table, cuts)
    grp = table["grp"].combine_chunks()
    cells, own = np.unique(cell, return_inverse=True)
    group = codes(grp)[row]
    each = own * (group.max() + 1) + group
    at, each, pos, a, b = _summed(each, pos, a, b)
    own, row = own[at], row[at]
    lead = np.flatnonzero(np.append(True, each[1:] != each[:-1]))[: len(each)]
    sizes = np.diff(lead, append=len(each))
    of = starts(np.bincount(own[lead], minlength=len(cells)))
    rows = starts(np.bincount(own, minlength=len(cells)))
    step = np.diff(pos, prepend=0)
    step[rows[:-1][np.diff(rows) > 0]] = pos[rows[:-1][np.diff(rows) > 0]]
    lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), grp.take(pa.array(row[lead])))
    return pa.record_batch([pa.array(cells.astype(np.int32)), lists, packed(sizes, of), packed(step, rows), packed(a, rows), packed(b, rows)], ["cell", "grps", "sizes", "pos", "a", "b"])


_PIECE = ["grp", "cell", "bgn", "end_", "open", "goes_on"]


def _pieces(table: pa.Table, cell: int, carried: tuple[int, int], bounds: tuple | None, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """grp, cell, bgn, end_, open, goes_on of the intervals of one cell; of a stretch, whether they begin or end beyond its bounds."""
    grp = table["grps"].combine_chunks().flatten()
    sizes, pos, a, b = ([numbers(x) for x in table[c].to_pylist()] for c in ("sizes", "pos", "a", "b"))
    row = np.repeat(np.arange(len(grp)), np.concatenate(sizes))
    at, group, pos, a, b = _summed(codes(grp)[row], np.concatenate([np.cumsum(x) for x in pos]), np.concatenate(a), np.concatenate(b))
    row = row[at]
    if not len(row):  # if some are open here, neighbouring stretches say so
        return pa.table({c: pa.array([], t) for c, t in zip(_PIECE, [grp.type, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()], strict=True)})
    # Over all of a group changes sum up to 0; a stretch has one group only.
    own = keep(np.cumsum(a) + carried[0] > 0, np.cumsum(b) + carried[1] > 0)
    began = bool(keep(np.array([carried[0] > 0]), np.array([carried[1] > 0]))[0])
    before = np.append(began, own)[:-1]
    first, last = np.flatnonzero(own & ~before), np.flatnonzero(~own & before)
    bgn, end, of = pos[first], pos[last], row[first]
    goes_on = bool(own[-1])
    if began:
        bgn, of = np.append(bounds[0], bgn), np.append(0, of)
    if goes_on:
        end = np.append(end, bounds[1])
    opened, on = np.zeros(len(bgn), bool), np.zeros(len(bgn), bool)
    opened[:1], on[-1:] = began, goes_on
    return pa.table([grp.take(pa.array(of.astype(np.int64))), pa.array(np.full(len(bgn), cell, np.int32)), *map(pa.array, (bgn.astype(np.int64), end.astype(np.int64), opened, on))], names=_PIECE)


def contained(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The rows of a (grp, bgn, end_, ...) all of whose positions are in intervals of b; empty intervals are in none."""
    whole = squash(b.filter("bgn < end_")).select("grp", F.col("bgn").alias("beg2"), F.col("end_").alias("end2"))
    return overlaps(a.filter("bgn < end_"), whole, width).filter("bgn >= beg2 and end_ <= end2").select(*a.columns)


def parse_region(text):
    """name, beg (0-based), end of 'name', 'name:beg' or 'name:beg-end'; digits can hold commas and end in k, M or G."""
    number = lambda g: F.when(F.regexp_extract(text, _REGION, g) != "", F.regexp_replace(F.regexp_extract(text, _REGION, g), ",", "").cast("long") * F.when(F.regexp_extract(text, _REGION, g + 1).isin("k", "K"), 1000).when(F.regexp_extract(text, _REGION, g + 1).isin("m", "M"), 1000000).when(F.regexp_extract(text, _REGION, g + 1).isin("g", "G"), 1000000000).otherwise(1))
    return F.struct(F.regexp_extract(text, _REGION, 1).alias("name"), (F.coalesce(number(2), F.lit(1)) - 1).alias("beg"), number(4).alias("end"))


_REGION = r"^([^:]+)(?::([0-9,]+)([kKmMgG]?)(?:-([0-9,]+)([kKmMgG]?))?)?$"
