"""Shared pieces: rows and keys, word and shingle hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import copied, dealt, heavy, heavy_of  # noqa: F401  for the operators
from ..sources.shared import made, materialise, remove  # noqa: F401

BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"
MASK40 = np.uint64((1 << 40) - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def boxed(df: DataFrame, **keys: Column) -> DataFrame:
    """row_, a struct of all of df's columns, and some computed from them: no name of df's can clash with later ones."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row_"), *(c.alias(k) for k, c in keys.items()))


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns out of row_ and new ones, which replace those of their name."""
    taken = {k.lower() for k in new}
    return df.select(*(F.col("row_").getField(c).alias(c) for c in columns if c.lower() not in taken), *(c.alias(k) for k, c in new.items()))


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits in 64-bit words, set where a row of slots (s) says so: a filter whose size doesn't grow with the rows."""
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    out, got = np.zeros(1 << (bits - 6), np.uint64), words.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def is_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become evenly spread hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of many texts at once, A-Z lower-cased, by prefix sums over bytes."""

    def __init__(self) -> None:
        self.pw, self.ipw = powers(0, _MULT), powers(0, _INV)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes; each text's first word (with a final entry for the end); byte start and end of each word within the joined texts."""
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if len(self.pw) < len(buf):
            self.pw, self.ipw = powers(len(buf) * 2, _MULT), powers(len(buf) * 2, _INV)
        low = _LOWER[buf]
        gap = _SPACE[buf]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.pw[: len(buf)], out=total[1:])
        words = mix((total[end] - total[start]) * self.ipw[start] + (end - start).astype(np.uint64))
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        return words, np.searchsorted(start, offsets), start, end


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash for each run of k words; one for the whole if there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * _STEP + words[j : n - size + 1 + j]
    return mix(out + np.uint64(size))


def batches(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of about limit bytes, a longer text alone, so that memory follows the longest text and not the batch."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def slices(rows: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what Python copies of a batch, and keeps, is then a small part of it."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Python batches of about BATCH bytes from now on, unless the session has a bound of its own.

    By default it hands 10,000 rows at once.  JVM and worker each hold that several times over, and neither gives all of
    it back, so that an executor that runs one operator after the other comes to hold the most that each has taken.
    """
    spark.conf.set(BATCH_BYTES, spark.conf.get(BATCH_BYTES, BATCH))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, comp): the smallest node reachable.  Alternating large and small stars; each round is
    a minimum per node, combined before the shuffle, joined back, and written to the shared folder.  Nodes without
    links, null ends and self-links give no row."""
    e = materialise(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        seen = tuple(state)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
