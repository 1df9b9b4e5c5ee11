"""Periodic run detection over words, by the runs theorem.

Of each order of words, the usual one and its reverse, the longest Lyndon word that begins at a place ends before the
next suffix that is smaller: the next smaller (for the reverse order, greater) value of the inverse suffix array.  The
root of every run is one of these.  A root is extended to the right by the longest common prefix of the suffixes at its
two ends, a minimum over the LCP array that a sparse table answers, and to the left by the same over the reversed words.

Documents of a batch are worked on together, each with letters of its own and a least letter behind it, so that no
suffix ties with one of another document.  All arrays are as long as the batch, or as the longest document, of which
prefix doubling keeps a copy for each doubling of the longest repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, slices

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 24, 3
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20


def suffixes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rank (the inverse suffix array) and lcp, where lcp[r] is the common prefix of the suffixes of ranks r - 1 and r.

    Prefix doubling among suffixes that still tie; letters of which a text's last one occurs once."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    sorted_ = letters[order]
    start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    size = np.diff(start, append=n)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(start, size)
    levels, reach = [rank], 1
    place = np.flatnonzero(np.repeat(size, size) > 1)  # of suffixes that tie, in the order so far
    while len(place):
        tied = order[place]
        key = rank[tied].astype(np.int64) * n + rank[tied + reach]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[place] = tied
        fresh = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[tied] = np.maximum.accumulate(np.where(fresh, place, 0))
        levels.append(rank)
        reach *= 2
        place = place[~(fresh & np.append(fresh[1:], True))]
    # How far neighbours agree: they are in one group of the levels below the one that parts them.
    lcp = np.zeros(n, np.int32)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    alike = [pair]
    for level in levels[1:]:
        alike.append(alike[-1][level[order[alike[-1]]] == level[order[alike[-1] - 1]]])
    for k in reversed(range(len(levels))):
        pair, level = alike[k], levels[k]
        same = level[order[pair] + lcp[pair]] == level[order[pair - 1] + lcp[pair]]
        lcp[pair[same]] += 1 << k
    return rank, lcp


def common_prefix(rank: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the suffixes at a and b (never the same) agree: range minima by a sparse table, one row of which is held at a time."""
    x, y = rank[a], rank[b]
    lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out, table = np.zeros(len(lo), np.int64), lcp
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: -(1 << k - 1)], table[1 << k - 1 :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
    return out


def next_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, len(x) if there is none.

    All places move at once, each to where the one it stands on points, as nothing between is smaller than that; the few
    that have many such steps to go are finished one by one, from the right."""
    n = len(x)
    to = np.arange(1, n + 1)
    low = np.append(x, x.min(initial=0) - 1)
    left = np.arange(n)
    while len(left) > 256:
        left = left[low[to[left]] > x[left]]
        to[left] = to[to[left]]
    for i in left[::-1].tolist():
        j, own = int(to[i]), x[i]
        while low[j] > own:
            j = int(to[j])
        to[i] = j
    return to


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, length, period of every run of the documents, whose words are given by numbers, one document after the other; by doc, start and period."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    span = int(ids.max(initial=0)) + 2
    place = np.arange(len(ids)) + doc  # behind each document stands a letter that comes before its others
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    end = begin + sizes

    def lettered(which: np.ndarray, backward: bool) -> np.ndarray:
        out = np.zeros(int((sizes[which] + 1).sum()), np.int64)
        own = np.repeat(np.arange(len(which)), sizes[which] + 1)
        first = np.cumsum(sizes[which] + 1) - (sizes[which] + 1)
        at = np.arange(len(out)) - first[own]
        word = at < sizes[which][own]
        source = (begin[which] - which)[own] + (sizes[which][own] - 1 - at if backward else at)
        out[word] = ids[source[word]] + 1
        return out + own * span

    letters = lettered(np.arange(len(sizes)), False)
    rank, lcp = suffixes(letters)
    found = []
    for value in (rank, -rank):
        i, j = place, next_smaller(value)[place]
        inside = np.flatnonzero(j < end[doc])
        inside = inside[letters[i[inside]] == letters[j[inside]]]
        found.append((doc[inside], i[inside], j[inside]))
    d, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    right, period = common_prefix(rank, lcp, i, j), j - i
    # A run's first root begins within its first period: what is left of it is shorter than that, so that the right part is long.
    good = right > np.maximum(least, times * period) - 2 * period
    d, i, j, right, period = d[good], i[good], j[good], right[good], period[good]
    left = np.zeros(len(i), np.int64)
    if len(d):
        which, own = np.unique(d, return_inverse=True)
        back = suffixes(lettered(which, True))
        last = np.cumsum(sizes[which] + 1) - 2  # where the first word of each is
        more = np.flatnonzero(i > begin[d])
        mirror = lambda at: (last[own] - (at - begin[d]))[more]
        left[more] = common_prefix(*back, mirror(i - 1), mirror(j - 1))
    start, length = i - left - begin[d], left + period + right
    good = length >= np.maximum(least, times * period)
    return tuple(np.unique(np.stack([d, start, period, length])[:, good], axis=1)[[0, 1, 3, 2]]) if good.any() else (np.zeros(0, np.int64),) * 4


def _summary(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """n_runs, the run of the greatest exponent, digests of all runs and of the words that stay."""
    listed = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    best = max(listed, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    text = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
    if listed:
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(listed), *shown, sha256(text.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest()


_OUT = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for each row of docs (doc_id,
    text): how many maximal runs of words its text has, the one with the greatest length / period (of several the first,
    then that of the smallest period), and digests of all runs and of the text with runs cut to their first period.

    `change` may give other words for a document's.  Null and empty texts have no words and no runs; doc_id may be null;
    repeated rows have equal results; further columns don't matter; an empty table gives an empty result.  Whole texts are
    searched: some 100 bytes of memory and more, by the logarithm of the longest repeat, for each word of the longest text.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            ids = batch.column(0).to_pylist()
            for at, texts in batches([t or b"" for t in batch.column(1).to_pylist()], BLOCK):
                split = [t.split() for t in texts]
                if change is not None:
                    split = [change(ids[at + k], w) for k, w in enumerate(split)]
                number: dict[bytes, int] = {}
                numbered = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
                doc, *found = find_runs(numbered, np.array([len(w) for w in split], np.int64), least, times)
                first = np.searchsorted(doc, np.arange(len(split) + 1))
                out = [(ids[at + k], *_summary(w, *(x[first[k] : first[k + 1]] for x in found))) for k, w in enumerate(split)]
                kinds = [pa.int64() if t == "long" else pa.string() for t in ("long", *_OUT.values())]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", *_OUT])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in _OUT.items()))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's words: those of each document chosen by a checksum of its id repeat from some place on; without an id they stay."""
    from zlib import crc32

    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
