"""Pairs of sequences: edit distance within Spark, other alignments by small vectorised dynamic programs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Global; -1 beyond `most`."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def letters(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _steps(a: str, b: str, free: bool) -> Iterator[tuple[int, int, int]]:
    """The columns of the edit matrix of a (down) against b, one after the other, as bits: where the cost grows downwards,
    where it falls, and by how much the last row changes.  The costs of a column are one number of len(a) bits, so a
    step takes a dozen operations on whole numbers, however long a is."""
    n = len(a)
    ones, top = (1 << n) - 1, 1 << n - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a) if n <= 512 else ():
        places[c] = places.get(c, 0) | 1 << i
    if n > 512:  # adding bit after bit would copy the number each time
        x = letters(a)
        places = {chr(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    grows, falls, lead = ones, 0, 0 if free else 1
    for c in b:
        same = places.get(c, 0)
        stays = (((same & grows) + grows) ^ grows) | same | falls
        right, left = falls | ones & ~(stays | grows), grows & stays
        change = (1 if right & top else 0) - (1 if left & top else 0)
        right, left = right << 1 & ones | lead, left << 1 & ones
        grows, falls = left | ones & ~((same | falls) | right), right & (same | falls)
        yield grows, falls, change


def last_row(a: str, b: str, free: bool = False) -> np.ndarray:
    """The least edits of a against b up to each end: against all of what lies before it or, if free, against any stretch that ends there."""
    if not a:
        return np.zeros(len(b) + 1, np.int64) if free else np.arange(len(b) + 1)
    return len(a) + np.cumsum(np.fromiter((0, *(x for _, _, x in _steps(a, b, free))), np.int64, len(b) + 1))


def last_column(a: str, b: str) -> np.ndarray:
    """The edits of each beginning of a against all of b."""
    grows, falls = (1 << len(a)) - 1, 0
    if a:
        for grows, falls, _ in _steps(a, b, False):  # noqa: B007  the last ones count
            pass
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)].astype(np.int64)
    return len(b) + np.append(0, np.cumsum(bits(grows) - bits(falls)))


def fit(a: str, b: str, prefix: bool) -> tuple[int, int, list[int]]:
    """Least edits of a against a prefix of b, or any stretch of it, the first end (exclusive) that has them, and all such ends."""
    row = last_row(a, b, not prefix)
    return int(row.min()), int(row.argmin()), np.flatnonzero(row == row.min()).tolist()


def fitted(a: Column, b: Column, prefix: bool = False) -> Column:
    """distance, end_, ends of a within b; null texts count as empty."""

    @F.pandas_udf("struct<distance:int,end_:int,ends:array<int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fit(p or "", q or "", prefix) for p, q in zip(x, y, strict=True)], columns=["distance", "end_", "ends"])

    return run(a, b)


def affine(a: str, b: str, mode: str, match: int = 2, mismatch: int = 4, opening: int = 4, extending: int = 2) -> tuple[int, int, int, int, int, str]:
    """score, bgn_a, end_a, bgn_b, end_b, cigar with affine gaps.

    mode local: any stretches; extend: both begin at 0; dovetail: an end of a against a beginning of b; contained: all
    of a within b.  A gap of n costs opening + n * extending, in local mode opening + (n - 1) * extending; there N scores
    0 against anything, and elsewhere as any letter.  An alignment without columns has score 0 and an empty cigar.
    Memory is that of as many rows as the root of len(a): about 17 * sqrt(len(a)) * len(b) bytes.
    """
    n, m = len(a), len(b)
    x, y = letters(a), letters(b)
    rows = _Rows(x, y, mode, match, mismatch, opening, extending)
    # Of every few rows one is kept, from which those up to the next are made again when the path comes to them.
    every = max(1, math.isqrt(n))
    kept, row = {0: rows.first()}, rows.first()
    best = (int(row[0].max()), 0, int(row[0].argmax())) if mode in ("local", "extend") or not n else None
    for i in range(1, n + 1):
        row = rows.after(i, *row)[:2]
        if i % every == 0:
            kept[i] = row
        if mode in ("local", "extend") or i == n:
            j = int(row[0].argmax())
            if best is None or row[0][j] > best[0]:
                best = (int(row[0][j]), i, j)
    score, i, j = best
    base, marks = i + 1, np.zeros((0, 0), np.uint8)

    def mark(i: int, j: int) -> int:
        nonlocal base, marks
        if i < base or not len(marks):
            base = max(0, (i - 1) // every * every)
            marks, row = np.zeros((min(every, n - base) + 1, m + 1), np.uint8), kept[base]
            if base == 0:
                marks[0] = rows.marks_of_first()
            for k in range(base + 1, min(base + every, i) + 1):
                *row, marks[k - base] = rows.after(k, *row, marked=True)
            base += base > 0  # its own marks are those of the block before
        return int(marks[i - (base - (base > 0)), j])

    bgn_a, bgn_b, cigar = _walk(a, b, i, j, mark)
    return score, bgn_a, i, bgn_b, j, cigar


def _walk(a: str, b: str, i: int, j: int, mark: Callable[[int, int], int]) -> tuple[int, int, str]:
    """Where the path that ends at a cell begins in a and in b, and its cigar."""
    ops, state = [], "h"
    while i or j:
        own = mark(i, j)
        if state == "h":
            if own & STOP:
                break
            if own & BOTH:
                ops.append("=" if a[i - 1] == b[j - 1] else "X")
                i, j = i - 1, j - 1
                continue
            state = "e" if own & DOWN else "f"
        if state == "e":
            ops.append("I")
            state = "e" if own & LONGER_DOWN else "h"
            i -= 1
        else:
            ops.append("D")
            state = "f" if own & LONGER_ALONG else "h"
            j -= 1
    ops.reverse()
    return i, j, "".join(f"{len(list(same))}{op}" for op, same in groupby(ops))


#: Pairs of one size are aligned together up to so many letters of a, as many as have about so many cells in a row.
TOGETHER, ABREAST = 512, 1 << 15


def affine_many(pairs: list[tuple[str, str]], mode: str, **costs: int) -> list[tuple[int, int, int, int, int, str]]:
    """affine of each pair.  The rows of pairs of the same two lengths are made at once, and all of their marks are kept."""
    out: list = [None] * len(pairs)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        if len(a) > TOGETHER or len(b) > ABREAST:
            out[k] = affine(a, b, mode, **costs)
        else:
            alike.setdefault((len(a), len(b)), []).append(k)
    for (n, m), some in alike.items():
        step = max(1, ABREAST // (m + 1))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            x, y = (np.stack([letters(pairs[k][side]) for k in part]) for side in (0, 1))
            rows = _Rows(x, y, mode, **costs)
            row, marks = rows.first(), np.zeros((len(part), n + 1, m + 1), np.uint8)
            marks[:, 0] = rows.marks_of_first()
            best = np.stack([row[0].max(axis=1), np.zeros(len(part), np.int64), row[0].argmax(axis=1)])
            for i in range(1, n + 1):
                *row, marks[:, i] = rows.after(i, *row, marked=True)
                if mode in ("local", "extend") or i == n:
                    j = row[0].argmax(axis=1)
                    own = np.stack([row[0][np.arange(len(part)), j], np.full(len(part), i), j])
                    best = np.where((own[0] > best[0]) | (mode not in ("local", "extend")), own, best)
            for k, score, i, j, held in zip(part, *best.tolist(), marks, strict=True):
                flat = held.tobytes()
                bgn_a, bgn_b, cigar = _walk(*pairs[k], i, j, lambda i, j, flat=flat: flat[i * (m + 1) + j])
                out[k] = (score, bgn_a, i, bgn_b, j, cigar)
    return out


#: What the path does at a cell: ends, takes a letter of both, takes one of a alone; and whether a gap goes on.
STOP, BOTH, DOWN, LONGER_DOWN, LONGER_ALONG = 1, 2, 4, 8, 16
_LOW = -(10**9)


class _Rows:
    """Rows of the matrices of affine alignment, each made from the one before: h the best score, e with a gap in b, f with one in a;
    of one pair, or of many of the same lengths, whose letters are then rows of x and y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, mode: str, match: int = 2, mismatch: int = 4, opening: int = 4, extending: int = 2) -> None:
        self.x, self.y, self.mode, self.extending = x, y, mode, extending
        self.opening = opening - extending if mode == "local" else opening
        self.match, self.mismatch = match, mismatch
        self.free_a, self.free_b = mode in ("local", "dovetail"), mode in ("local", "contained")
        self.slope = extending * np.arange(y.shape[-1] + 1)
        self.blank = ord("N") if mode == "local" else -1
        self.steps: dict[int, np.ndarray] = {}

    def gap(self, k: np.ndarray | int) -> np.ndarray | int:
        return -(self.opening + self.extending * k)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        shape = (*self.y.shape[:-1], self.y.shape[-1] + 1)
        h, e = np.zeros(shape, np.int64), np.full(shape, _LOW)
        if not self.free_b:
            h[..., 1:] = self.gap(np.arange(1, shape[-1]))
        return h, e

    def marks_of_first(self) -> np.ndarray:
        out = np.full(self.y.shape[-1] + 1, STOP if self.free_b else LONGER_ALONG, np.uint8)
        out[:2] &= ~np.uint8(LONGER_ALONG)  # the gap opens
        return out

    def step(self, i: int) -> np.ndarray:
        """What letter i of a scores against all of b."""
        worth = lambda c: np.where((self.y == self.blank) | (c == self.blank), 0, np.where(self.y == c, self.match, -self.mismatch))
        if self.x.ndim > 1:
            return worth(self.x[..., i - 1, None])
        c = int(self.x[i - 1])
        if c not in self.steps:
            if len(self.steps) > 16:  # letters, of which there are few, or all kinds of characters
                self.steps.clear()
            self.steps[c] = worth(c)
        return self.steps[c]

    def after(self, i: int, h: np.ndarray, e: np.ndarray, marked: bool = False) -> tuple:
        """Row i, from 1, and with `marked` what the path does at its cells."""
        opening, extending = self.opening, self.extending
        down = np.maximum(e, h - opening) - extending
        edge = 0 if self.free_a else self.gap(i)
        if not self.free_a:
            down[..., 0] = edge
        both = h[..., :-1] + self.step(i)
        new = np.empty_like(h)
        new[..., 0] = edge
        np.maximum(both, down[..., 1:], out=new[..., 1:])
        if self.mode == "local":
            np.maximum(new[..., 1:], 0, out=new[..., 1:])
        along = np.full(h.shape, _LOW)
        along[..., 1:] = np.maximum.accumulate(new + self.slope, axis=-1)[..., :-1] - self.slope[1:] - opening
        np.maximum(new[..., 1:], along[..., 1:], out=new[..., 1:])
        if not marked:
            return new, down
        marks = np.zeros(h.shape, np.uint8)
        marks[..., 1:] = np.where(new[..., 1:] == both, BOTH, np.where(new[..., 1:] == down[..., 1:], DOWN, 0))
        marks[..., 0] = STOP if self.free_a else DOWN
        if self.mode == "local":
            marks[new == 0] |= STOP
        if i > 1:
            marks[(down == e - extending) & (down != h - opening - extending)] |= LONGER_DOWN
        marks[..., 2:][(along[..., 2:] == along[..., 1:-1] - extending) & (along[..., 2:] != new[..., 1:-1] - opening - extending)] |= LONGER_ALONG
        if not self.free_a:
            marks[..., 0] = DOWN | (LONGER_DOWN if i > 1 else 0)
        return new, down, marks


def aligned(a: Column, b: Column, mode: str = "local", **costs: int) -> Column:
    @F.pandas_udf("struct<score:int,bgn_a:int,end_a:int,bgn_b:int,end_b:int,cigar:string>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = affine_many([(p or "", q or "") for p, q in zip(x, y, strict=True)], mode, **costs)
        return pd.DataFrame(rows, columns=["score", "bgn_a", "end_a", "bgn_b", "end_b", "cigar"])

    return run(a, b)


#: Cells of an edit matrix that is held whole; beyond, a path is found by halves.
CELLS = 1 << 20


def _path(a: str, b: str) -> str:
    """The columns (= X I D) of a best path of all of a against all of b: where the matrix is large, a row between the halves of
    the longer text says where the path crosses it, so that memory is linear in the texts."""
    n, m = len(a), len(b)
    if (n + 1) * (m + 1) > CELLS and min(n, m) > 1:
        if n < m:
            half = m // 2
            cut = int((last_column(a, b[:half]) + last_column(a[::-1], b[half:][::-1])[::-1]).argmin())
            return _path(a[:cut], b[:half]) + _path(a[cut:], b[half:])
        half = n // 2
        cut = int((last_row(a[:half], b) + last_row(a[half:][::-1], b[::-1])[::-1]).argmin())
        return _path(a[:half], b[:cut]) + _path(a[half:], b[cut:])
    at, x, y = np.arange(m + 1), letters(a), letters(b)
    rows = [at]
    for i in range(1, n + 1):
        row = rows[-1]
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (y != x[i - 1])))
        rows.append(np.minimum.accumulate(new - at) + at)
    i, j, ops = n, m, []
    while i or j:
        here = rows[i][j]
        if i and j and here == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            ops.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and here == rows[i - 1][j] + 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return "".join(reversed(ops))


def edit_path(a: str, b: str, mode: str) -> tuple[int, int, int, str, str, str]:
    """distance, start and end in b, cigar (= X I D; I stands in a alone), and both texts with gaps.

    mode global: all of b; prefix: a beginning of b; infix: any stretch, the first end with the least distance, and of the
    starts that give it the last.  Among equal paths of up to CELLS cells a column of both comes before I, and I before D;
    of larger ones any of the least cost is taken.  In the shown texts equal letters are lower-case and different ones
    upper-case.  Memory is linear in the texts.
    """
    row = last_row(a, b, mode == "infix")
    end = len(b) if mode == "global" else int(row.argmin())
    distance = int(row[end])
    start = 0
    if mode == "infix":
        back = last_row(a[::-1], b[:end][::-1])
        start = end - int(np.flatnonzero(back == distance)[0])
    ops = _path(a, b[start:end])
    i, j, shown_a, shown_b = 0, start, [], []
    for op, run in groupby(ops):
        k = len(list(run))
        case = str.lower if op == "=" else str.upper
        shown_a.append("-" * k if op == "D" else "".join(map(case, a[i : i + k])))
        shown_b.append("-" * k if op == "I" else "".join(map(case, b[j : j + k])))
        i += k * (op != "D")
        j += k * (op != "I")
    return distance, start, end, "".join(f"{len(list(run))}{op}" for op, run in groupby(ops)), "".join(shown_a), "".join(shown_b)


def edit_paths(a: Column, b: Column, mode: str = "global") -> Column:
    """The struct of edit_path for each pair; null texts count as empty."""

    @F.pandas_udf("struct<distance:int,bgn:int,end_:int,cigar:string,shown_a:string,shown_b:string>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [edit_path(p or "", q or "", mode) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["distance", "bgn", "end_", "cigar", "shown_a", "shown_b"])

    return run(a, b)


def error_rate(tallies: dict[str, Column]) -> Column:
    """Mismatches and gaps over the shorter of the two lengths; null without an alignment."""
    shorter = F.least(tallies["query_len"], tallies["ref_len"])
    return F.when(shorter > 0, (tallies["mismatches"] + tallies["gaps"]) / shorter)


def identity(tallies: dict[str, Column]) -> Column:
    """Matches over alignment columns; null without an alignment."""
    return F.when(tallies["columns"] > 0, tallies["matches"] / tallies["columns"])


def path_summary(cigar: Column) -> Column:
    """matches, mismatches, inserted and deleted letters, and how many stretches of the two there are."""
    runs = lambda op: F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    total = lambda op: F.aggregate(runs(op), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.struct(total("=").alias("matches"), total("X").alias("mismatches"), total("I").alias("inserted"), total("D").alias("deleted"), F.size(runs("I")).alias("insert_opens"), F.size(runs("D")).alias("delete_opens"))
