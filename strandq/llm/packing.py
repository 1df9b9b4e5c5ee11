"""Order-preserving packing of documents into token sequences by dynamic programming.

Candidate cuts are document ends and sentence ends; only stretches of over 1024 tokens without either are cut inside.  A
sequence [i, j) costs its padding (none at a power of two), a fixed cost, and a penalty if j cuts a document.  The
cheapest cut before j lies in a sliding window of 1024 tokens, kept as a monotone queue; sequences of a half, a quarter
and an eighth are looked up.  Each partition is one stream in its own order,
so nothing is shuffled, and memory holds one block of tokens.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Penalties in tokens of padding: per sequence, per cut at a sentence end, per cut within a sentence.
EACH, SENTENCE, INSIDE = 4, 1, 6
#: Tokens that the dynamic program sees at once, and words remembered by a tokenizer.
BLOCK, REMEMBERED = 1 << 18, 400_000
#: Fixed value: the pre-tokenizer of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = re.compile(r" (?=\S)")
_ODD = r" (?=\s|$)"


def _byte_signs() -> dict[str, int]:
    """The sign of each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Token ids, as little-endian 32-bit bytes, of words with the space before them; the pre-tokenizer always parts there.

    The vocabulary is read from a byte-level tokenizers file, whose ids are in merge order, and merged by tiktoken, which
    gives the same ids at five times the speed.  Words are remembered, up to a bound.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer, signs = Tokenizer.from_file(path), _byte_signs()
        vocabulary = {t: i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in signs for c in t)}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(signs[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.special = {t: tokenizer.token_to_id(t) for t in special}
        self.odd = re.compile("|".join([_ODD, *map(re.escape, special)]))
        self.whole = tokenizer
        self.one = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in vocabulary.items():
            ends[i] = token[-1] in ".!?\u010a" or "\u010a" in token  # the sign of a line end
        self.ends = ends

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = array("I", self.one(" " + word)).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """As the tokenizers file does, special tokens not added; texts with other white space or special tokens go through it whole."""
        if not text:
            return b""
        if self.odd.search(text) is not None:
            if any(t in text for t in self.special):
                return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            first, *rest = _SPLIT.split(text)
        else:
            first, *rest = text.split(" ")
        head = array("I", self.one(first)).tobytes() if first else b""
        return head + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """Kept for the next task of the same Python worker."""
    return Words(path)


def cuts(at: list[int], penalty: list[int], limit: int = LIMIT) -> tuple[list[int], list[int]]:
    """For candidate positions `at` (ascending, behind 0, gaps at most limit): the least cost of a packing that ends at each, and the cut before it."""
    cost, before = [0], [-1]
    where = {0: 0}
    pos = [0, *at]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # cost + position ascending, number of the cut
    small = [limit >> k for k in (3, 2, 1)]
    for j, (p, fine) in enumerate(zip(at, penalty, strict=True), 1):
        while pos[queue[0][1]] < p - limit:
            queue.popleft()
        value, i = queue[0]
        value += limit - p
        for length in small:
            k = where.get(p - length)
            if k is not None and cost[k] < value:
                value, i = cost[k], k
        value += fine + EACH
        cost.append(value)
        before.append(i)
        where[p] = j
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    return cost, before


def _candidates(ids: np.ndarray, ends: np.ndarray, flags: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Positions and penalties; a stretch without sentence ends is cut each `limit` tokens."""
    good = flags[ids]
    at = np.union1d(np.flatnonzero(good) + 1, ends)
    at = at[at > 0]
    gaps = np.diff(at, prepend=0)
    if gaps.max(initial=0) > limit:
        k = -(-gaps // limit)
        start = np.repeat(at - gaps, k)
        nth = np.arange(len(start)) - np.repeat(np.cumsum(k) - k, k) + 1
        at = np.minimum(start + nth * limit, np.repeat(at, k))
    penalty = np.full(len(at), INSIDE)
    penalty[good[at - 1]] = SENTENCE
    penalty[np.isin(at, ends, assume_unique=True)] = 0
    return at.tolist(), penalty.tolist()


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's ids are those of its text and then id 0; null and empty texts have that alone.  Rows with equal or null
    doc_id are packed as they come, each on its own.  The last tokens of a partition fill sequences of powers of
    two.  sequence_id is unique over all partitions; a partition that is computed again gives the same rows.  Further
    columns are ignored, and an empty table gives an empty result.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = words_of(path)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[list] = []  # of each document in the buffer: id, tokens, ids, start of the part that is left
        size = 0

        def flush(last: bool) -> pd.DataFrame:
            nonlocal held, size, number
            raw = b"".join(x[2] for x in held)
            ids = np.frombuffer(raw, "<u4")
            ends = np.cumsum([len(x[2]) >> 2 for x in held])
            at, penalty = _candidates(ids, ends, words.ends, limit)
            cost, before = cuts(at, penalty, limit)
            pos = [0, *at]
            j = len(at)
            if not last:  # leave what follows the cheapest of the last cuts for the next block
                j = min((k for k in range(len(at), 0, -1) if pos[k] > pos[-1] - limit), key=lambda k: (cost[k], -k))
            done, path_ = pos[j], []
            while j > 0:
                path_.append((pos[before[j]], pos[j]))
                j = before[j]
            path_.reverse()
            if last:
                fine: list[tuple[int, int]] = []
                for a, b in path_[-1:]:
                    while b - a & b - a - 1:
                        step = 1 << (b - a).bit_length() - 1
                        fine.append((a, a + step))
                        a += step
                    fine.append((a, b))
                path_[-1:] = fine
            out, d, begin = [], 0, 0
            for a, b in path_:
                offset = 0
                while a < b:
                    doc, total, own, start = held[d]
                    stop = min(b, begin + (len(own) >> 2))
                    part = raw[a * 4 : stop * 4]
                    out.append((doc, start + a - begin, stop - a, zlib.crc32(part), total, number, offset, part))
                    offset += stop - a
                    a = stop
                    if a == begin + (len(own) >> 2):
                        begin, d = a, d + 1
                number += 1
            if d < len(held) and done > begin:
                doc, total, own, start = held[d]
                held[d] = [doc, total, own[(done - begin) * 4 :], start + done - begin]
            held = held[d:]
            size = sum(len(x[2]) for x in held) >> 2
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})

        for part in parts:
            ids, texts = part["doc_id"].tolist(), [t or "" for t in part["text"]]
            for doc, text in zip(ids, texts, strict=True):
                own = words.encode(text) + b"\0\0\0\0"
                held.append([None if pd.isna(doc) else int(doc), len(own) >> 2, own, 0])
                size += len(own) >> 2
                if size >= BLOCK:
                    yield flush(False)
        if held:
            yield flush(True)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def padding(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """tokens, sequences and padding over all sequences."""
    n = F.col("n")
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return each.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(limit - n)).alias("padding"))
