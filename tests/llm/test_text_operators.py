"""Line dedup, periodic runs and importance resampling against brute force, with edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandq.llm import line_dedup, resample, runs
from strandq.operators import skew

SCHEMA = "doc_id long, text string, lang string, k int, pos string, score int, start string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", 1, "p", 2, "q") for i, t in enumerate(texts)], SCHEMA)


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\x0b\x0c\r"))


def brute_lines(rows):
    """(doc_id, text) to (n_lines, n_dropped, text)."""
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key_of(line)) >= 10:
                holders[key_of(line)].add(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if d is None or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == d]
        out.append((d, len(every), len(every) - len(kept), None if t is None else "\n".join(kept)))
    return out


def line_corpus():
    r = random.Random(3)
    pool = [" ".join(r.choice(["Alpha", "beta", "ÉTÉ", "été", "Straße", "x"]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = ["\n".join(r.choice(["", " ", "\t", "\x0b"]) + r.choice(pool) + r.choice(["", "\r", " ", "  "]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    common = "this line stands in all of them"
    texts += [f"{common}\nown {i} and more\n{common.upper()}\n" for i in range(80)]
    return [*texts, None, "", "\n", "\n\n", "ten chars!", " Ten Chars! ", "nine char", "nine char", "x" * 100_000, "x" * 100_000, "same same same\n" * 3000, "İstanbul is a city\nistanbul is a city"]


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "LEAST", 2)
    texts = line_corpus()
    ids = [*range(len(texts) - 3, -1, -1), None, None]
    rows = [(*x, "l", 1, "p", 2, "q") for x in [*zip(ids, texts, strict=True), (0, texts[0]), (0, "another text of a known id\n" + texts[0]), (None, texts[1])]]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "lang", "k", "pos", "score", "start", "text", "n_lines", "n_dropped"]
    order = lambda x: sorted(x, key=str)
    assert order((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == order(brute_lines([(x[0], x[1]) for x in rows]))
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    three = line_dedup.drop_repeated_lines(frame(spark, ["a line of text"] * 2 + ["some other line"] * 3), documents=3)
    assert sorted((r.doc_id, r.n_dropped) for r in three.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_line_dedup_is_native(spark):
    plan = line_dedup.drop_repeated_lines(frame(spark, line_corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_runs(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_summary(w, found):
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def run_corpus():
    r = random.Random(5)
    out = []
    for _ in range(150):  # repeats within repeats, in small alphabets
        w = []
        for _ in range(r.randint(0, 4)):
            part = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 9))]
            part = part * r.choice([1, 2, 3, 5, 9]) + [r.choice("abcd") for _ in range(r.randint(0, 3))]
            w += part * r.choice([1, 1, 3, 4])
        out.append(" ".join(w))
    out += ["a" + " b" * 400, "b " * 400 + "a", "x " * 23, "x " * 24, " ".join("abcdefgh") + " abcdefgh", " ".join(list("abcdefgh") * 3), " ".join([*"abcdefgh"] * 3)[:-2]]
    out += [" ".join(str(r.randint(0, 50)) for _ in range(800)), " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(500, 0, -1))]
    return [*out, None, "", " \n\t", "one", "É é   É é", " ".join(["ä b c"] * 40)]


def split(text):
    return [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]


@pytest.mark.parametrize("change", [None, runs.planted])
def test_runs(spark, change):
    texts = run_corpus() + [" ".join(str(k) for k in range(60 + i)) for i in range(40)]
    got = sorted(runs.periodic_runs(frame(spark, texts), change).collect())
    for i, t in enumerate(texts):
        w = split(t)
        h = crc32(str(i).encode())
        if change and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(len(w))]
        assert tuple(got[i]) == (i, *brute_summary(w, brute_runs(w))), t


def test_runs_of_long_and_odd_rows(spark):
    long = " ".join([*(f"w{i}" for i in range(5000)), *(f"v{i % 7000}" for i in range(50_000)), "a", *["b"] * 30_000])
    got = {r.doc_id: r for r in runs.periodic_runs(frame(spark, [long, "a " * 30, "a " * 30, None], [5, None, None, 7]), runs.planted).collect() if r.doc_id}
    assert (got[5].n_runs, got[5].start, got[5].length, got[5].period, got[5].exponent_milli) == (2, 55_001, 30_000, 1, 30_000_000)
    assert got[5].runs_sha256 == sha256(b"5000,50000,7000\n55001,30000,1\n").hexdigest()
    assert got[7].n_runs == 0 and got[7].start is None and got[7].collapsed_sha256 == sha256(b"").hexdigest()
    odd = runs.periodic_runs(frame(spark, ["a " * 30] * 3, [None, 4, 4]), runs.planted).collect()
    assert [(r.doc_id, r.n_runs) for r in odd] == [(None, 1), (4, 1), (4, 1)]
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_arrays():
    r = np.random.RandomState(1)
    for n, k in [(1, 1), (2, 1), (40, 1), (300, 2), (3000, 3)]:
        x = np.append(r.randint(1, k + 1, n), 0)
        rank, lcp = runs.suffixes(x)
        order = sorted(range(n + 1), key=lambda i: x[i:].tolist())
        assert np.argsort(rank).tolist() == order
        agree = lambda a, b: next((d for d in range(n + 1) if x[a + d] != x[b + d]))
        assert lcp[1:].tolist() == [agree(order[i - 1], order[i]) for i in range(1, n + 1)]
        a, b = r.randint(0, n + 1, (2, 100))
        good = a != b
        assert runs.common_prefix(rank, lcp, a[good], b[good]).tolist() == [agree(p, q) for p, q in zip(a[good], b[good], strict=True)]
        assert runs.next_smaller(rank).tolist() == [next((j for j in range(i + 1, n + 1) if rank[j] < rank[i]), n + 1) for i in range(n + 1)]


def brute_resample(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    docs = [(d, *feats(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in feats(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for d, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0]))
    for i, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = i
    return sorted(map(tuple, out), key=str)


def test_resample(spark):
    r = random.Random(11)
    pool = ["alpha", "Beta", "été", "ÉTÉ", "x1", "9", "long-er", "don't", "日本", "a\x00b"]
    texts = [r.choice(["", "\n"]).join([" ".join(r.choice(pool[: r.randint(2, 10)]) for _ in range(r.randint(0, 60)))]) for _ in range(400)] + [None, "", "?!", "one", "z" * 50_000, "word " * 30_000]
    ids = [*range(len(texts) - 1), None]
    target = ["alpha beta alpha 9", "x1 x1 x1", None]
    rows = list(zip(ids, texts, strict=True))
    got = resample.resample(frame(spark, texts, ids), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target)
    same = resample.resample(frame(spark, [" ".join(["w"] * 30)] * 9 + ["w"], [4] * 9 + [1]), spark.createDataFrame([], "text string"), percent=50).collect()
    assert sorted((x.rank or 0) for x in same) == [0] * 6 + [1, 2, 3, 4] and len({x.score for x in same if x.doc_id == 4}) == 1
    assert resample.resample(spark.createDataFrame([], SCHEMA), frame(spark, target)).count() == 0
    with pytest.raises(ValueError):
        resample.streams(frame(spark, texts), 1 << 17)
    small = resample.resample(frame(spark, texts, ids), frame(spark, target), percent=100, least_words=0, buckets=50, seed=1)
    assert sorted(map(tuple, small.collect()), key=str) == brute_resample(rows, target, 100, 0, 50, 1)


def test_streams_in_blocks(spark, monkeypatch):
    """Whatever the blocks, counts and weights are the same."""
    texts = [f"some words {i} " * (i % 7) for i in range(200)]
    rows, target = list(enumerate(texts)), ["some words"]
    monkeypatch.setattr(resample, "BLOCK", 100)
    got = resample.resample(frame(spark, texts), frame(spark, target), least_words=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, least=3)
