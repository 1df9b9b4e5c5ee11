"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of doc_id, doc_id), so that equal texts lie together.  Exact byte counts
below candidate boundaries are taken over all partitions: a histogram of the leading bits of the order key, then of
the next bits inside the few cells that hold a splitter, until each splitter is within tolerance of its target or its
cell holds a single key.  A group of equal texts larger than a cell allows is divided further by the second key.  Only
histograms (at most CELLS rows per open splitter) reach the driver.  Then rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialise, unboxed

BITS = 12
CELLS = 1 << BITS
#: The share of a shard's bytes by which a boundary may miss its target before it is refined further.
TOLERANCE = 0.0005


def _digit(level: int):
    """Digit number `level`, of BITS bits, of the 128-bit order key; the last digit of each half is shorter."""
    key, k = ("k1", level) if level < 6 else ("k2", level - 6)
    shift = max(0, 64 - BITS * (k + 1))
    width = BITS if k < 5 else 64 - 5 * BITS
    return F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def keys(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """size (UTF-8 bytes, none for null, plus 1) and the two halves of the order key."""
    return {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "k1": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "k2": F.xxhash64(F.col(doc_id).cast("string")),
    }


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """For each inner boundary the digits of the first cell behind it; rows must have keys()."""
    done: dict[int, tuple[int, ...]] = {}
    open_: dict[int, tuple[tuple[int, ...], int]] = {i: ((), 0) for i in range(1, shards)}  # boundary: cell and the bytes before it
    total = 0
    one = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2"))
    for level in range(12):
        if not open_:
            break
        cells = {c for c, _ in open_.values()}
        path = F.array(*(_digit(j) for j in range(level))) if level else F.array().cast("array<int>")
        within = rows if not level else rows.filter(path.isin(*[F.array(*map(F.lit, c)) for c in cells]))
        found: dict[tuple[int, ...], list] = {}
        for c, d, size, single in within.groupBy(path.alias("c"), _digit(level).alias("d")).agg(F.sum("size"), one).orderBy("c", "d").toLocalIterator():
            found.setdefault(tuple(c), []).append((d, size, single))
        if not found:
            break
        total = total or sum(size for _, size, _ in found[()])
        for i, (cell, before) in list(open_.items()):
            target, at = i * total / shards, before
            for d, size, single in found[cell]:
                if at + size > target or d == found[cell][-1][0]:
                    break
                at += size
            miss = min(abs(target - at), abs(at + size - target))
            if miss <= tolerance * total / shards or single or level == 11:
                done[i] = (*cell, d if abs(target - at) <= abs(at + size - target) else d + 1)
                del open_[i]
            else:
                open_[i] = ((*cell, d), at)
    return [done.get(i, ()) for i in range(1, shards)]


def _behind(bound: tuple[int, ...]):
    """Whether a row's key is at or behind a boundary: a comparison of digits."""
    out = F.lit(True)
    for level in reversed(range(len(bound))):
        d = _digit(level)
        out = (d > bound[level]) | ((d == bound[level]) & out)
    return out


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size, shard (0 to shards - 1; bytes per shard near equal) and slot (gapless from 0 within a shard).

    Equal texts lie next to each other, so that a group of them is in one shard unless a boundary falls into it; then it
    is divided by doc_id, as the law of bytes asks.  Null and empty texts have size 1 and form one group of equal texts;
    a null doc_id is a value like others.  Repeated rows are kept, each with its slot.  A shard can stay empty if there
    are fewer rows than shards.  An empty table gives an empty result.  A single text, however long, is never divided, so
    a boundary misses its target by at most half of the text that lies across it.  Columns of docs may have any name;
    those named like the three new ones are replaced.
    """
    slim = materialise(docs.select(*(c.alias(k) for k, c in keys().items())))
    bounds = splitters(slim, shards, tolerance)
    bits = min(20, max(4, (slim.count() // 4096).bit_length()))
    return unboxed(place(boxed(docs, doc_id=F.col("doc_id"), **keys()), bounds, bits), docs.columns, size=F.col("size"), shard=F.col("shard"), slot=F.col("slot"))


def place(rows: DataFrame, bounds: list[tuple[int, ...]], bits: int) -> DataFrame:
    """The one exchange, of rows with doc_id and keys(): by shard and a fine cell of both keys, within which slots are numbered; offsets come from counts per cell."""
    at = sum((_behind(b).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)
    cell = F.shiftrightunsigned("k1", 64 - bits).cast("int")
    part = F.shiftrightunsigned("k2", 58).cast("int")  # a group of equal texts is spread over 64 cells
    rows = rows.withColumns({"shard": at, "cell": cell, "part": part})
    key = ["shard", "cell", "part"]
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("k1", "k2", "doc_id")))
    return numbered.join(counts, key).withColumn("slot", F.col("before") + F.col("nth") - 1)
