"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes puts a cut where its top bits are zero, so cuts follow content and an insertion moves
only the chunks that it touches.  Chunks are counted by 128-bit digest with map-side combining; those that occur in two
or more documents are joined back and neighbours merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bitmap, boxed, copied, dealt, heavy_of, is_set, materialise, unboxed

#: One cut in 2**CUT_BITS positions on average; cuts that follow another within LEAST bytes don't count; longer
#: stretches are cut each MOST bytes.  A passage is found but for at most two chunks at its ends.
CUT_BITS, LEAST, MOST = 4, 16, 64
#: A chunk of MOST bytes that repeats itself after at most so many bytes says nothing of where it comes from, and is left out.
PERIOD = 16
#: The least length in bytes of a reported span.
SPAN = 120
#: Bits of the filter that spares the join most chunks that occur once: the bound of what is broadcast, whatever the corpus.
FILTER_BITS = 24
_GEAR = np.random.RandomState(20240229).randint(0, 1 << 16, 256).astype(np.uint16)
_PAD = 16


class Chunker:
    def __call__(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per text: its number, starts and lengths of its chunks, which together cover it."""
        for at, part in batches(texts):
            raw = np.frombuffer((b"\0" * _PAD).join(part) + b"\0" * (_PAD + 4), np.uint8)
            gear = _GEAR[raw]
            gear[raw == 0] = 0  # what lies before a text has no part in its hashes
            for step in (1, 2, 4, 8):
                gear[step:] = gear[step:] + (gear[:-step] << np.uint16(step))
            cuts = np.flatnonzero(gear >> np.uint16(16 - CUT_BITS) == 0) + 1
            for _ in range(3):  # to the next start of a character
                cuts = cuts + (raw[np.minimum(cuts, len(raw) - 1)] & 0xC0 == 0x80)
            begin = 0
            for i, t in enumerate(part):
                end = begin + len(t)
                own = cuts[np.searchsorted(cuts, begin, side="right") : np.searchsorted(cuts, end)]
                own = own[np.diff(own, prepend=begin) >= LEAST]
                edges = np.concatenate([[begin], own, [end]])
                if (gaps := np.diff(edges)).max(initial=0) > MOST:
                    k = np.maximum(1, -(-gaps // MOST))
                    first = np.repeat(edges[:-1], k)
                    nth = np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
                    edges = np.append(first + nth * MOST, end)
                    for _ in range(3):
                        edges[1:-1] += raw[edges[1:-1]] & 0xC0 == 0x80
                if len(t):
                    yield at + i, edges[:-1] - begin, np.diff(edges)
                begin = end + _PAD


def _telling(text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which chunks don't merely repeat a few bytes: only those that were cut for their length can."""
    out = np.ones(len(start), bool)
    if len(long := np.flatnonzero(size == MOST)):
        rows = np.frombuffer(text, np.uint8)[start[long][:, None] + np.arange(MOST)]
        out[long] = ~np.any([(rows[:, p:] == rows[:, :-p]).all(axis=1) for p in range(1, PERIOD + 1)], axis=0)
    return out


def chunks(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """doc_id, k (a hash of the text), start, size (bytes of the UTF-8 text), d1 and d2 (the digest) of each chunk; null and
    empty texts have none.  With `known`, bits by d1, only the chunks whose bit is set."""
    bits = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Chunker()
        for batch in rows:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo in range(0, len(ids), 256):
                texts = [b"" if x is None else x for x in batch.column(2).slice(lo, 256).cast(pa.binary()).to_pylist()]
                which, starts, sizes, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                for i, start, size in cut(texts):
                    good, t = _telling(texts[i], start, size), texts[i]
                    start, size = start[good], size[good]
                    digests += [blake2b(t[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]
                    which.append(np.full(len(start), lo + i))
                    starts.append(start)
                    sizes.append(size)
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                n, start, size = map(np.concatenate, (which, starts, sizes))
                if bits is not None:
                    good = is_set(bits.value, digest[:, 0] & (1 << FILTER_BITS) - 1)
                    digest, n, start, size = digest[good], n[good], start[good], size[good]
                columns = (ids[n].astype(np.int64), keys[n].astype(np.int64), start.astype(np.int64), size.astype(np.int32), digest[:, 0], digest[:, 1])
                yield pa.record_batch([pa.array(x) for x in columns], ["doc_id", "k", "start", "size", "d1", "d2"])

    rows = docs.filter("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    return rows.mapInArrow(run, "doc_id long, k long, start long, size int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, least: int = SPAN) -> DataFrame:
    """doc_id, start, size, chunks, first_doc, is_first, text_hash for each span of at least `least` bytes all of whose chunks
    occur in another document too; first_doc is the smallest doc_id that has one of them, is_first says that all occur here
    first.

    Rows without doc_id, null and empty texts have no spans.  Rows with equal doc_id count as one document, each text with
    spans of its own (text_hash tells them apart, repeated rows count once), and repeats within one document don't count.
    Stretches that only repeat up to PERIOD bytes again and again belong to no span.  Further columns of docs don't matter;
    an empty table gives an empty result.
    """
    digest = ["d1", "d2"]
    many = chunks(docs).groupBy(*digest).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    many = materialise(many.select(*digest, "lo", "n"))
    hot = heavy_of(many, digest, many.agg(F.sum("n")).first()[0] or 0)
    known = bitmap(many.select(F.col("d1").bitwiseAND((1 << FILTER_BITS) - 1).alias("s")), FILTER_BITS)
    cut = dealt(chunks(docs, known), hot, digest, "doc_id", "start")
    shared = cut.join(copied(many.drop("n"), hot, digest), [*digest, "cell"]).select("doc_id", "k", "start", "size", "lo").distinct()
    w = Window.partitionBy("doc_id", "k").orderBy("start")
    fresh = F.when(F.col("start") == F.lag(F.col("start") + F.col("size")).over(w), 0).otherwise(1)
    runs = shared.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    out = runs.groupBy("doc_id", "k", "run").agg(
        F.min("start").alias("start"), F.sum("size").cast("long").alias("size"), F.count("*").alias("chunks"),
        F.min("lo").alias("first_doc"), F.min((F.col("lo") == F.col("doc_id")).cast("int")).cast("boolean").alias("is_first"))
    return out.filter(F.col("size") >= least).drop("run").withColumnRenamed("k", "text_hash")


def drop_repeats(docs: DataFrame, least: int = SPAN) -> DataFrame:
    """docs without the repeated spans that occur earlier in another document.

    Null texts, rows without id and other columns, of whatever names, stay; repeated rows are cut alike; an empty table
    gives an empty result.
    """
    spans = repeated_spans(docs, least).filter("not is_first").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, some):
            if t is None or some is None:
                return t
            raw, at, out = t.encode(), 0, []
            for s in some:
                out.append(raw[at : s["start"]])
                at = s["start"] + s["size"]
            return b"".join([*out, raw[at:]]).decode(errors="replace")

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    rows = boxed(docs, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64("text")).join(spans, ["doc_id", "text_hash"], "left")
    return unboxed(rows, docs.columns, text=cut(F.col("row_.text"), F.col("spans"))).select(*(F.col(f"`{c}`") for c in docs.columns))
