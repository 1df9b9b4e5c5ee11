"""Benchmark decontamination: rare word pairs of test items seed a join with training passages; Smith-Waterman
alignment over words then scores exact, edited and paraphrased copies.

Two matched words next to each other in the alignment cost nothing if they are neighbours in item and passage, 1 if one
word is between them in either or both, else 2 or more.  So an item of n words that scores T has, among the pairs of its
neighbouring words, at least (2T - 3 - n) / 3 that the passage has as neighbours or with one word between them.  Half of
these may be the item's most frequent pairs, so that they needn't be joined; a passage that has fewer of the others is
left out.  Frequencies, and so the number of copies, decide only what is joined, never what is found.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _STEP, WordHasher, batches, bitmap, boxed, copied, dealt, heavy_of, is_set, materialise, mix, slices, unboxed

#: Bits of the filter that spares the join most n-grams: 2**FILTER_BITS bits is the proven bound of the broadcast.
FILTER_BITS = 22
#: Alignment: a match, and the cost of a changed, missing or added word; least_hits holds for these two.
MATCH, COST = 2, 1
#: The least score, as a share of an exact copy's, that counts as a leak.
LEAK = 0.5
#: A pair of more items than this is no seed where an item has enough others.
SHARED = 8
#: Places of hits are told in units of 2**UNIT words.
UNIT = 4
_PLAIN = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in range(256)).translate(bytes(i + 32 if 65 <= i < 91 else i for i in range(256)))


def plain(text: str | None) -> bytes:
    """Lower-case ASCII letters, digits and bytes beyond ASCII; all else parts words."""
    return (text or "").encode(errors="replace").translate(_PLAIN)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score of two arrays of word ids, with the stretch [start, end) of the passage that it covers."""
    n = len(passage)
    slope = COST * np.arange(n + 1)
    row, origin = np.zeros(n + 1), np.arange(n + 1)
    best, start, end = 0.0, 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, -COST)
        up = row - COST
        new, made = up.copy(), origin.copy()
        better = diagonal > new[1:]
        new[1:][better], made[1:][better] = diagonal[better], origin[:-1][better]
        dead = new <= 0
        new[dead] = 0
        made[dead] = np.flatnonzero(dead)
        level = np.maximum.accumulate(new + slope)
        source = np.maximum.accumulate(np.where(new + slope == level, np.arange(n + 1), 0))
        row, origin = level - slope, made[source]
        j = int(row.argmax())
        if row[j] > best:
            best, start, end = float(row[j]), int(origin[j]), j
    return best, start, end


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    return mix(words[:-apart] * _STEP + words[apart:])


def _words(texts: list[bytes], hasher: WordHasher) -> Iterator[tuple[int, np.ndarray]]:
    """Per text: its number and the hashes of its words."""
    for at, part in batches(texts):
        words, first, _, _ = hasher(part)
        for i in range(len(part)):
            yield at + i, words[first[i] : first[i + 1]]


def least_hits(n: int, least: float) -> int:
    """How many pairs of neighbours of an item of n words any passage has that reaches `least`; below 1, neighbours alone prove nothing."""
    return math.ceil((2 * least * MATCH * n - 3 - n) / 3 - 1e-9)


def item_grams(items: DataFrame, least: float = LEAK) -> DataFrame:
    """item, gram, times, words, hits for each word pair of each item (item, text): at least `hits` of them are in a leak.

    Where neighbours alone prove nothing, words with one between them count too, and one hit is enough.  Items of which a
    single matching word reaches `least` (at LEAK: of one or two words) have none and can't be found.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for part in parts:
            keys, rows = part["item"].tolist(), []
            for i, w in _words([plain(t) for t in part["text"]], hasher):
                if least * MATCH * len(w) > MATCH:
                    hits = least_hits(len(w), least)
                    grams = _pairs(w, 1) if hits >= 1 else np.concatenate([_pairs(w, 1), _pairs(w, 2)])
                    rows += [(keys[i], g, k, len(w), max(hits, 1)) for g, k in Counter(grams.view(np.int64).tolist()).items()]
            yield pd.DataFrame(rows, columns=["item", "gram", "times", "words", "hits"])

    return items.select("item", "text").mapInPandas(run, "item long, gram long, times int, words int, hits int")


def _filter(grams: DataFrame) -> np.ndarray:
    return bitmap(grams.select(F.col("gram").bitwiseAND((1 << FILTER_BITS) - 1).alias("s")), FILTER_BITS)


def _hits(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's pairs, with at most one word between, that pass the filter."""
    at, grams = [], []
    for apart in (1, 2):
        g = _pairs(words, apart)
        hit = np.flatnonzero(is_set(known, (g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)))
        at.append(hit)
        grams.append(g[hit])
    return np.concatenate(at), np.concatenate(grams)


def gram_frequencies(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, df over all documents, for the word pairs of the benchmark."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(grams))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(rows):
            seen: Counter = Counter()
            for _, words in _words([plain(t) for t in batch.column(0).to_pylist()], hasher):
                _, hit = _hits(words, bits.value)
                if len(hit):
                    seen.update(np.unique(hit).view(np.int64).tolist())
            yield pa.record_batch({"gram": pa.array(list(seen), pa.int64()), "df": pa.array(list(seen.values()), pa.int64())})

    found = docs.select("text").mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    return found.join(grams.select("gram").distinct(), "gram", "left_semi")


def rare_seeds(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """item, gram, times, words, need, df: per item its pairs without those that many items share and the most frequent others, and how many of those left a leak has at least."""
    shared = grams.groupBy("gram").agg(F.count("*").alias("items"))
    counted = grams.join(shared.join(gram_frequencies(docs, grams), "gram", "left").fillna(0, ["df"]), "gram").withColumn("shared", F.col("items") > SHARED)
    common = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("shared"), F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, 0))
    most = F.when(F.col("shared"), F.col("hits") - 1).otherwise(F.floor(F.col("hits") / 2))
    counted = counted.withColumn("left_out", F.when(common <= most, F.col("times")).otherwise(0))
    need = F.col("hits") - F.sum("left_out").over(Window.partitionBy("item"))
    return counted.withColumn("need", need).filter("left_out = 0").select("item", "gram", "times", "words", "need", "df")


def _scale(words: Column, least: float) -> Column:
    """log2 of an item's step.  An alignment that reaches `least` covers at most (3 - MATCH * least) * words words, so it lies
    within one of the blocks of two steps that begin at each step."""
    return F.greatest(F.ceil(F.log2(F.ceil(words * (3 - MATCH * least)) + 1)), F.lit(UNIT)).cast("int")


def _place(doc, scale, block):
    """The place of a block of a document in a filter; on columns, numbers and arrays."""
    return doc % (1 << 40) * 1_000_003 + block * 7919 + scale * 104_729


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word for each document (doc_id, text) and item (item_id, text) whose best
    alignment reaches `least` of an exact copy's score; words are counted from 0 in the document.

    Null and empty texts have no leaks.  Rows with one doc_id count as one document.  Rows without doc_id or item_id
    are left out of the pairs.  Items of one or two words, of which a single word reaches LEAK, can't be found.  Texts
    and items can be of any length; further columns don't matter; empty tables give an empty result.
    """
    items = materialise(benchmark.selectExpr("cast(item_id as bigint) item_id", "text").filter("item_id is not null and text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text")))
    grams = materialise(item_grams(items, least))
    seeds = materialise(rare_seeds(docs, grams).withColumn("scale", _scale(F.col("words"), least)))
    scales = sorted(r["scale"] for r in seeds.select("scale").distinct().collect())  # powers of two: a few dozen at most
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(_filter(seeds))

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(rows):
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for i, words in _words([plain(t) for t in batch.column(1).to_pylist()], hasher):
                at, g = _hits(words, bits.value)
                if ids[i] is None or not len(g):
                    continue
                unit = at >> UNIT
                order = np.lexsort((g, unit))
                unit, g = unit[order], g[order].view(np.int64)
                new = np.append(True, (unit[1:] != unit[:-1]) | (g[1:] != g[:-1]))
                for column, x in zip(out, (np.full(new.sum(), ids[i], np.int64), np.full(new.sum(), len(words), np.int64), unit[new], g[new]), strict=True):
                    column.append(x)
            yield pa.record_batch([pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in out], ["doc_id", "n_words", "unit", "gram"])

    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    # Pairs of very many documents are dealt to cells.  Their number is that of documents, so hits may be a few times as many.
    often = seeds.groupBy("gram").agg(F.max("df").alias("n"))
    hot = heavy_of(often, ["gram"], often.agg(F.sum("n")).first()[0] or 0)
    hits = dealt(texts.mapInArrow(find, "doc_id long, n_words long, unit long, gram long"), hot, ["gram"], "doc_id", "unit").join(copied(seeds.drop("df"), hot, ["gram"]), ["gram", "cell"])
    last = F.expr("greatest(shiftright(n_words + shiftleft(1L, scale) - 1, scale) - 2, 0L)")
    block = F.expr(f"shiftright(unit, scale - {UNIT})")
    blocks = F.array_distinct(F.array(F.least(block, last), F.greatest(F.least(block - 1, last), F.lit(0))))
    hits = hits.select("doc_id", "scale", F.explode(blocks).alias("block"), "item", "gram", "times", "need")
    # Rows with one doc_id may add hits of their own, which can only add candidates.
    own = ["doc_id", "scale", "block", "item"]
    found = hits.repartition(*own).groupBy(*own, "gram").agg(F.first("times").alias("times"), F.first("need").alias("need"))
    found = materialise(found.groupBy(*own).agg(F.sum("times").alias("n"), F.first("need").alias("need")).filter("n >= need").select(*own))
    slots = found.select(_place(F.pmod("doc_id", F.lit(1 << 40)), F.col("scale"), F.col("block")).bitwiseAND((1 << FILTER_BITS) - 1).alias("s"))
    wanted = context.broadcast(bitmap(slots, FILTER_BITS))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                words = None
                for scale in scales:
                    may = np.flatnonzero(is_set(wanted.value, _place(doc, scale, np.arange((len(text) >> scale) + 1)) & (1 << FILTER_BITS) - 1))
                    if len(may) and words is None:
                        words = plain(text).split()
                    for k in may.tolist():
                        if k << scale < len(words):
                            for column, x in zip(out, (doc, scale, k, b" ".join(words[k << scale : k + 2 << scale]).decode(errors="replace")), strict=True):
                                column.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc_id", "scale", "block", "passage"])

    passages = texts.mapInArrow(cut, "doc_id long, scale int, block long, passage string")

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, item, first, text, passage in zip(part["doc_id"], part["item_id"], part["first"], part["text"], part["passage"], strict=True):
                number: dict[bytes, int] = {}
                own, other = plain(text).split(), passage.encode().split()
                goal = least * MATCH * len(own)
                if MATCH * sum((Counter(own) & Counter(other)).values()) < goal:
                    continue
                x, y = (np.array([number.setdefault(w, len(number)) for w in t]) for t in (own, other))
                best, s, e = align(x, y)
                if best >= goal:
                    rows.append((doc, item, best / (MATCH * len(x)), first + s, first + e))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word"])

    scored = passages.join(found.join(items, "item"), ["doc_id", "scale", "block"]).select("doc_id", "item_id", F.expr("shiftleft(block, scale)").alias("first"), "text", "passage")
    scored = scored.mapInPandas(judge, "doc_id long, item_id long, score double, start_word long, end_word long")
    best = F.max(F.struct("score", -F.col("start_word"), -F.col("end_word")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("start_word"), (-F.col("b.col3")).alias("end_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """The rows of docs that no item leaks into; rows without doc_id stay, and further columns of whatever names."""
    found = leaks(docs, benchmark, least).select(F.col("doc_id").alias("doc_id_")).distinct()
    return unboxed(boxed(docs, doc_id_=F.col("doc_id").cast("long")).join(found, "doc_id_", "left_anti"), docs.columns)
