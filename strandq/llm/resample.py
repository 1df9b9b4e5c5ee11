"""Target-distribution importance resampling over hashed word n-grams.

Each document becomes a stream of its features' buckets, packed as uint16; streams of neighbouring documents make a
block with the documents' offsets, and blocks are written to the shared folder.  Counting is an external sort-count: each
block is sorted and run-length encoded by itself, and only (bucket, count) goes through the shuffle.  The gains of
buckets, a table of at most 2**16 numbers, are then gathered along the written streams and summed per document with
np.add.reduceat.  Gumbel noise from a digest of doc_id makes the highest scores a draw without replacement; ranks come
from counts per score, so that no window holds more than the documents of one score.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialise, slices

#: The method's parameters: buckets, the words that a document needs to be drawn, percent of these that are drawn, seed.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text whose streams make a block; a longer text has one alone.
BLOCK = 1 << 20
#: Bytes of words, A-Z lower-cased; all others part words.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_STREAMS = "doc_ids binary, known binary, words binary, sizes binary, stream binary"


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stream of the texts' buckets, a word's and that of the pair it begins side by side, and how many words and features each text has."""
    split = [t.translate(_WORDS).split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    words = [w for each in split for w in each]
    own = [crc32(w) for w in words]
    pair = [crc32(b, crc32(b" ", a)) for a, b in zip(own, [*words[1:], b""], strict=False)]
    both = np.empty((len(words), 2), np.int64)
    both[:, 0], both[:, 1] = own, pair
    there = np.ones((len(words), 2), bool)
    there[np.cumsum(n)[n > 0] - 1, 1] = False  # the last word of a text begins no pair
    return (both % buckets)[there].astype(np.uint16), n, np.maximum(2 * n - 1, 0)


def streams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Blocks: packed doc_ids (int64), which of them are known (bool), numbers of words and features (int64), stream (uint16)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            ids = batch.column(0)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for at, texts in batches([t or b"" for t in batch.column(1).to_pylist()], BLOCK):
                stream, words, sizes = features(texts, buckets)
                part = slice(at, at + len(texts))
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (ids[part], known[part], words, sizes, stream)], ["doc_ids", "known", "words", "sizes", "stream"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _STREAMS)


def counts(blocks: DataFrame) -> DataFrame:
    """bucket, n of written streams: blocks sorted and run-length encoded one by one, their runs merged per task and then over all."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in rows:
            for packed in batch.column(0):
                stream = np.sort(np.frombuffer(packed.as_buffer(), np.uint16))
                first = np.flatnonzero(np.append(True, stream[1:] != stream[:-1])) if len(stream) else np.zeros(0, np.int64)
                total[stream[first]] += np.diff(first, append=len(stream))
        there = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(there.astype(np.int32)), "n": pa.array(total[there])})

    return blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket how much more of the target than of the corpus it is: floor(1000 * log ratio), counts plus 1; from counts (bucket, n)."""

    def per_bucket(rows: DataFrame) -> np.ndarray:
        out, got = np.zeros(buckets), rows.toPandas()  # a row per bucket at most
        out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
        return out

    s, t = per_bucket(corpus), per_bucket(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each document's features, 0 without any."""
    table = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                ids, known, words, sizes, stream = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, bool, np.int64, np.int64, np.uint16)))
                weight, some = np.zeros(len(ids), np.int64), sizes > 0
                if some.any():
                    weight[some] = np.add.reduceat(table.value[stream], (np.cumsum(sizes) - sizes)[some]) // sizes[some]
                yield pa.record_batch([pa.array(ids, mask=~known), pa.array(words), pa.array(sizes), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs (doc_id, text); target has a column text.

    Of the N rows with at least least_words words, those with the floor(percent * N / 100) highest scores are drawn and
    ranked from 1, equal scores by doc_id; rank is null for all others.  Null and empty texts have no features and weight 0.
    A null doc_id is scored as the text `null` and comes first among equal scores; repeated rows are each scored, and
    ranked in any order among themselves.  Texts can be of any length; one text's stream is in one task.  Further columns don't matter.  Without
    a target the weights favour what is rare in docs; an empty docs gives an empty result.
    """
    blocks = materialise(streams(docs, buckets))
    gain = gains(counts(blocks), counts(streams(target.select(F.lit(0).alias("doc_id"), "text"), buckets)), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weights(blocks, gain).withColumn("score", (F.col("weight") + noise).cast("long")))
    able = scored.filter(F.col("n_words") >= least_words)
    each = able.groupBy("score").agg(F.count("*").alias("n"))  # scores are whole thousandths of a logarithm: some ten thousand, whatever the corpus
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = percent * able.count() // 100
    better = each.select("score", before.alias("before")).filter(F.col("before") < quota)
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    ranked = able.join(F.broadcast(better), "score").withColumn("place", F.col("before") + nth)
    rank = F.when(F.col("place") <= quota, F.col("place"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns).unionByName(able.join(F.broadcast(better), "score", "left_anti").select(*columns))
    return ranked.select(*columns, rank.cast("long").alias("rank")).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
