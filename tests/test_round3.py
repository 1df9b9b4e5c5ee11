"""Realignment, likelihoods, long pairs, two-word k-mers, pile-ups and the rest, against plain versions."""

import itertools
import math
import random
import re
import resource
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandq.operators import alignment, headers, intervals, kmers, qualities, records, sequences, skew, stats
from strandq.streaming import counting


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def applied(cigar, a, b):
    """The edits of a path, which must use up both texts and match where it says so."""
    i = j = cost = 0
    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        for _ in range(int(n)):
            if op in "=X":
                assert (a[i] == b[j]) == (op == "=")
            cost += op != "="
            i, j = i + (op != "D"), j + (op != "I")
    assert (i, j) == (len(a), len(b))
    return cost


def test_paths_by_halves(monkeypatch):
    r = random.Random(8)
    pairs = [("".join(r.choice("ACGé") for _ in range(r.randint(0, 60))), "".join(r.choice("ACGé") for _ in range(r.randint(0, 60)))) for _ in range(300)]
    whole = {p: [alignment.edit_path(*p, mode) for mode in ("global", "prefix", "infix")] for p in pairs}
    monkeypatch.setattr(alignment, "CELLS", 30)
    for (a, b), want in whole.items():
        for mode, w in zip(("global", "prefix", "infix"), want, strict=True):
            got = alignment.edit_path(a, b, mode)
            assert got[:3] == w[:3] and applied(got[3], a, b[got[1] : got[2]]) == got[0]
            assert got[4].replace("-", "").upper() == a.upper() and got[5].replace("-", "").upper() == b[got[1] : got[2]].upper()
        assert want[0][0] == plain_distance(a, b)
        assert want[1][0] == min(plain_distance(a, b[:k]) for k in range(len(b) + 1))


def test_long_pairs_in_little_memory():
    r = random.Random(9)
    a = "".join(r.choice("ACGT") for _ in range(40_000))
    b = list(a)
    for _ in range(2000):
        k = r.randrange(len(b))
        b[k : k + 1] = r.choice([[], ["A"], ["C", "G"]])
    b = "".join(b)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    distance, bgn, end, cigar, _, _ = alignment.edit_path(a, b, "global")
    assert applied(cigar, a, b) == distance <= 4000 and (bgn, end) == (0, len(b))
    score, *_, cigar = alignment.affine(a[:3000], b[:3000], "local")
    assert score > 3000 and cigar
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # whole matrices would take 12 GB


def test_letters_beyond_ascii(spark):
    assert alignment.fit("é", "e", False)[0] == 1 and alignment.fit("é", "xé", False) == (0, 2, [2]) and alignment.fit("日本", "日x本", True)[0] == 1
    assert alignment.affine("Ae", "Aé", "local") == (2, 0, 1, 0, 1, "1=")
    assert alignment.affine("日本語", "x日本語", "contained")[0] == 6
    row = spark.createDataFrame([("Aé", "é")], "a string, b string").select(alignment.fitted(F.col("a"), F.col("b")).alias("f"), alignment.aligned(F.col("a"), F.col("b")).alias("g")).first()
    assert row.f.distance == 1 and row.g.score == 2


def plain_posteriors(ref, query, error, gaps):
    """Forward and backward chances over the whole matrix, cell by cell."""
    n, m, (d, e) = len(query), len(ref), gaps
    s = 1 / (2 * n + 2)
    t = {"MM": (1 - 2 * d) * (1 - s), "MI": d * (1 - s), "MD": d * (1 - s), "IM": (1 - e) * (1 - s), "II": e * (1 - s), "DM": 1 - e, "DD": e}
    emit = lambda i, k: 1.0 if ref[k - 1] > 3 or query[i - 1] > 3 else 1 - error[i - 1] if ref[k - 1] == query[i - 1] else error[i - 1] * 0.33333333333
    f, b = defaultdict(float), defaultdict(float)
    for i in range(1, n + 1):
        for k in range(1, m + 1):
            if i == 1:
                f["M", i, k], f["I", i, k] = emit(i, k) * (1 - d) / m, 0.25 * d / m
                continue
            f["M", i, k] = emit(i, k) * (t["MM"] * f["M", i - 1, k - 1] + t["IM"] * f["I", i - 1, k - 1] + t["DM"] * f["D", i - 1, k - 1])
            f["I", i, k] = 0.25 * (t["MI"] * f["M", i - 1, k] + t["II"] * f["I", i - 1, k])
            f["D", i, k] = t["MD"] * f["M", i, k - 1] + t["DD"] * f["D", i, k - 1]
    for i in range(n, 0, -1):
        for k in range(m, 0, -1):
            if i == n:
                b["M", i, k] = b["I", i, k] = s
                continue
            on = emit(i + 1, k + 1) * b["M", i + 1, k + 1] if k < m else 0.0
            b["D", i, k] = (t["DM"] * on + t["DD"] * b["D", i, k + 1]) * (i > 1)
            b["M", i, k] = t["MM"] * on + 0.25 * t["MI"] * b["I", i + 1, k] + t["MD"] * b["D", i, k + 1]
            b["I", i, k] = t["IM"] * on + 0.25 * t["II"] * b["I", i + 1, k]
    out = []
    for i in range(1, n + 1):
        each = {(k, x): f[x, i, k] * b[x, i, k] for k in range(1, m + 1) for x in "MI"}
        (k, x), top = max(each.items(), key=lambda z: z[1])
        out.append((k - 1, x == "I", top / sum(each.values())))
    return out


def test_posteriors_are_those_of_the_whole_matrix():
    r = random.Random(12)
    for n, m, gaps in [(1, 1, (0.001, 0.1)), (6, 9, (0.05, 0.3)), (20, 17, (0.001, 0.1)), (24, 30, (1e-7, 0.1)), (15, 15, (0.2, 0.5))]:
        ref = [r.choice([0, 1, 2, 3, 3, 4]) for _ in range(m)]
        reads = []
        for _ in range(4):
            at = r.randrange(max(1, m - n + 1))
            q = (ref[at : at + n] + [r.randrange(4) for _ in range(n)])[:n]
            q[r.randrange(n)] = r.randrange(5)
            reads.append(q)
        error = np.array([[10 ** -r.choice([0.5, 1, 2, 3]) for _ in range(n)] for _ in reads])
        placed, inserted, quality = qualities.posteriors(np.array([ref] * 4), np.array(reads), error, 100, gaps)
        for k, q in enumerate(reads):
            want = plain_posteriors(ref, q, error[k], gaps)
            for i, (at, ins, p) in enumerate(want):
                ours = 99 if quality[k, i] >= 99 else quality[k, i]
                phred = min(99, int(-4.343 * math.log(max(1e-300, 1 - p)) + 0.499))
                assert abs(ours - phred) <= 1, (n, m, i)
                if p > 0.5:
                    assert (placed[k, i], inserted[k, i]) == (at, ins)


def test_realigned(spark):
    """Bases beside a hidden insertion lose their quality, others keep it; a narrow band agrees with the whole matrix."""
    r = random.Random(5)
    ref = "".join(r.choice("ACGT") for _ in range(200))
    read = ref[50:90]
    shifted = ref[50:85] + ref[86:91]  # a deletion near the end, written as matches
    rows = [(0, 50, "40M", read, "I" * 40), (1, 50, "40M", shifted, "I" * 40), (2, 47, "3S37M", "GGG" + ref[47:84], "I" * 40), (3, 50, "20M2I18M", ref[50:70] + "AC" + ref[70:88], "I" * 40),
            (4, 50, "*", read, "I" * 40), (5, 50, "10M10N30M", read, "I" * 40), (6, 50, "39M", read, "I" * 40), (7, 50, "40M", read, None), (8, None, "40M", read, "I" * 40), (9, 0, "2M", "AC", "I!"), (10, 50, "40I", read, "I" * 40), (11, 500, "40M", read, "I" * 40)]
    df = spark.createDataFrame([(*x, "c", ref) for x in rows], "id int, pos long, cigar string, seq string, qual string, chrom string, ref string")
    got = {x.id: x.capped for x in qualities.realigned(df).collect()}
    assert got[0][4:36] == got[1][4:25] + "I" * 11 == "I" * 32 and all(ord(c) - 33 < 20 for c in got[1][36:])
    assert got[2][:3] == "III" and got[3][20:22] == "II" and got[3][4:15] == "I" * 11
    assert [got[k] for k in (4, 5, 6, 7, 8, 10, 11)] == [None] * 7 and len(got[9]) == 2
    for x in rows[:4]:
        ops = qualities._blocks(x[2])
        begin, end, reach = qualities._window(x[1], ops, 40)
        found = plain_posteriors(qualities.base_codes(ref[begin:end]).tolist(), qualities.base_codes(x[3]).tolist(), [1e-4] * 40, (0.001, 0.1))
        aligned, y, at = {}, 0, x[1]
        for op, n in ops:
            if op == "M":
                aligned |= {y + k: at + k for k in range(n)}
            y, at = y + n * (op in "MIS"), at + n * (op in "MD")
        for i, (place, ins, p) in enumerate(found):
            phred = min(40, int(-4.343 * math.log(max(1e-12, 1 - p)) + 0.499))
            want = 40 if i not in aligned else phred if not ins and place + begin == aligned[i] else 0
            assert abs(ord(got[x[0]][i]) - 33 - want) <= 1, (x, i)
    wide = {x.id: x.capped for x in qualities.realigned(df, extended=True).collect()}
    assert all(a is None or all(p <= q for p, q in zip(a, wide[k], strict=True)) for k, a in got.items())
    pieces = qualities.with_reference(df.drop("ref"), spark.createDataFrame([("c", ref)], "chrom string, bases string"))
    assert {x.id: x.capped for x in qualities.realigned(pieces).collect()} == {k: v for k, v in got.items() if k not in (4, 8, 11)} | ({11: None} if pieces.filter("id = 11").count() else {})
    assert qualities.realigned(df.limit(0)).count() == 0


def plain_likelihoods(bases, dependent=0.17):
    """Base after base, from the best quality down."""
    n, c, w, cost = len(bases), Counter(), Counter(), Counter()
    tail = lambda k, e: sum(math.comb(n, j) * e**j * (1 - e) ** (n - j) for j in range(k, n + 1))
    for q, s, b in sorted(bases, reverse=True):
        e = 10 ** (-q / 10)
        cost[b] += ((1 - dependent) ** w[s, b] * 0.97 + 0.03) * -10 * math.log10(tail(c[b] + 1, e) / tail(c[b], e))
        c[b] += 1
        w[s, b] += 1
    out = []
    for i, j in itertools.combinations_with_replacement(range(4), 2):
        rest = sum(cost[k] for k in range(4) if k not in (i, j))
        if i != j:
            rest += -4.343 * (math.log(math.comb(c[i] + c[j], c[i])) - (c[i] + c[j]) * math.log(2))
        out.append(max(0.0, rest))
    return out


def test_genotype_likelihoods(spark):
    r = random.Random(4)
    rows = [(p, r.choice("ACGTacgtN"), r.choice([0, 3, 20, 30, 40, 70, None]), r.choice([0, 0, 1, None])) for p in range(30) for _ in range(r.randint(0, 40))]
    rows += [(99, "A", 30, 0)] * 3000 + [(99, "C", 20, 1)] * 10 + [(98, None, 3, 0), (98, "-", 30, 1)]
    df = spark.createDataFrame([("c", *x) for x in rows], "chrom string, pos int, base string, quality int, strand int")
    got = {x.pos: x for x in qualities.genotype_likelihoods(df).collect()}
    for p in range(30):
        own = [(max(4, min(63, q)), s, "ACGT".index(b.upper())) for at, b, q, s in rows if at == p and b in "ACGTacgt" and q is not None and s is not None]
        assert (p in got) == bool(own)
        if own:
            assert got[p].depth == len(own) and np.allclose(got[p].likelihoods, plain_likelihoods(own), rtol=1e-6, atol=1e-6)
    assert got[99].depth == 3010 and got[99].likelihoods[0] == min(got[99].likelihoods) and 98 not in got
    assert qualities.genotype_likelihoods(df.limit(0)).count() == 0


def plain_covered(pos, cigar, seq, qual):
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)(\D)", cigar)]
    out, a, b, last = [], 0, pos, None
    for n, op in ops:
        for _ in range(n):
            if op in "M=X":
                out.append([b, seq[a], ord(qual[a]) - 33, ""])
            elif op == "D":
                out.append([b, "-", ord(qual[a - 1]) - 33 if a else None, ""])
            elif op == "I" and last is not None:
                out[last][3] += seq[a]
            last = len(out) - 1 if op in "M=XD" else None if op in "NS" else last
            a, b = a + (op in "MIS=X"), b + (op in "MDN=X")
    return [(p, x, q, i or None) for p, x, q, i in out]


def test_pileup_columns(spark):
    r = random.Random(6)
    rows = []
    for k in range(200):
        ops = [(r.randint(1, 4), r.choice("MIDX=PNS")) for _ in range(r.randint(1, 7))]
        n = sum(x for x, op in ops if op in "MIS=X")
        rows.append((k, f"s{k % 2}", "c", r.randint(0, 20), "".join(f"{x}{op}" for x, op in ops), "".join(r.choice("ACGT") for _ in range(n)), "".join(chr(r.randint(35, 70)) for _ in range(n))))
    df = spark.createDataFrame(rows + [(500, "s0", "c", 3, "*", "A", "I"), (501, "s0", "c", 3, None, None, None)], "id int, sample string, chrom string, pos long, cigar string, seq string, qual string")
    got = sorted(((x.id, x.pos, x.base, x.quality, x.inserted) for x in sequences.covered(df, "id").collect()), key=str)
    assert got == sorted(((x[0], *c) for x in rows for c in plain_covered(*x[3:])), key=str)
    piled = {(x["sample"], x.pos, x.base, x.inserted): x.n for x in sequences.pileup(df, "sample").collect()}
    assert piled == Counter((x[1], p, b, i) for x in rows for p, b, _, i in plain_covered(*x[3:]))
    assert sequences.pileup(df.drop("qual").filter("id = 0")).agg(F.sum("quality")).first()[0] is None and sequences.pileup(df.limit(0)).count() == 0


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("k", [1, 5, 31, 32, 33, 47, 63, 64, 70])
def test_long_kmers(spark, k):
    r = random.Random(k)
    base = "".join(r.choice("ACGT") for _ in range(90))
    reads = [base, turned(base), base[:50] + "N" + base[51:], "A" + base[1:k], "C" + base[1:k], "A" * k + "C" * k, "g" * 70, None, "", "é" * 80, base * 3]
    df = spark.createDataFrame(list(enumerate(reads)), "seq_idx long, bases string")
    order = str.maketrans("ACTG", "0123")
    least = lambda w: min(w, turned(w), key=lambda x: x.translate(order))
    at = [(i, p, least(w)) for i, t in enumerate(reads) for p in range(len(t or "") - k + 1) if re.fullmatch("[ACGT]+", w := t[p : p + k].upper())]
    assert {x.kmer: x.value for x in kmers.count(df, k).collect()} == Counter(w for _, _, w in at)
    if k > 64:
        with pytest.raises(ValueError):
            kmers.positions(df, df, k)
        return
    some = df.filter("seq_idx in (1, 3, 4)")
    want = sorted((i, p, j, q, w) for i, p, w in at if i in (1, 3, 4) for j, q, v in at if v == w)
    assert sorted(map(tuple, kmers.positions(some, df, k).collect())) == want


def test_medians_of_doubles(spark):
    rows = [("a", 1.5), ("a", 2.0), ("a", 9.0), ("a", 2.25), ("b", -1.0), ("c", None)]
    df = spark.createDataFrame(rows, "grp string, x double")
    assert {x.grp: x["median"] for x in stats.median(df).collect()} == {"a": 2.125, "b": -1.0}
    assert {x.grp: x.mad for x in stats.mad(df).collect()} == {"a": 0.625, "b": 0.0}
    whole = df.selectExpr("grp", "cast(x * 2 as int) as x")
    assert {x.grp: x["median"] for x in stats.median(whole).collect()} == {"a": 4, "b": -2}


def test_stretches_grow_with_rows(spark, monkeypatch):
    assert stats.stretches(10, 8) == 8 and stats.stretches(10**13, 200) == -(-(10**13) // stats.STRETCH)
    monkeypatch.setattr(stats, "STRETCH", 100)
    r = random.Random(3)
    rows = [(0 if r.random() < 0.5 else r.randint(1, 5), b := r.randint(0, 3000), b + r.randint(0, 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "grp int, bgn long, end_ long")
    cells = stats.ordered_cells(df, "bgn").groupBy("cell").count().collect()
    assert len(cells) >= 25 and max(x["count"] for x in cells) < 400
    depth = Counter()
    for g, b, e in rows:
        depth.update((g, p) for p in range(b, e))
    got = {(x.grp, p): x.depth for x in intervals.depth(df).collect() for p in range(x.bgn, x.end_) if x.depth}
    assert got == depth
    merged = {(x.grp, x.bgn, x.end_, x.num) for x in intervals.squash(df).collect()}
    want = set()
    for g in range(6):
        open_ = None
        for b, e in sorted((b, e) for h, b, e in rows if h == g):
            if open_ and (open_[1] >= b or e <= open_[1]):
                open_ = [open_[0], max(open_[1], e), open_[2] + 1]
            else:
                want |= {(g, *open_)} if open_ else set()
                open_ = [b, e, 1]
        want |= {(g, *open_)} if open_ else set()
    assert merged == want


def test_hot_bins(spark, monkeypatch):
    """One bin with most of the rows is dealt to cells, each of a bounded share."""
    monkeypatch.setattr(skew, "LEAST", 50)
    r = random.Random(1)
    left = [(0, b := r.randint(0, 40), b + r.randint(1, 5), i) for i in range(1500)] + [(r.randint(1, 9), b := r.randint(0, 9000), b + 3, 2000 + i) for i in range(300)]
    right = [(r.randint(0, 9), b := r.randint(0, 60), b + r.randint(1, 300), i) for i in range(40)]
    x, y = spark.createDataFrame(left, "grp int, bgn long, end_ long, id int"), spark.createDataFrame(right, "grp int, beg2 long, end2 long, id2 int")
    out = intervals.overlaps(x, y, 64)
    assert out.columns == ["grp", "bgn", "end_", "id", "beg2", "end2", "id2"]
    assert sorted((p.id, p.id2) for p in out.collect()) == sorted((p[3], q[3]) for p in left for q in right if p[0] == q[0] and p[1] < q[2] and p[2] > q[1])


def test_latest_after_a_restart(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "k string, v long"
    table = lambda: spark.readStream.schema(schema).parquet(source).groupBy("k").agg(F.sum("v").alias("v"))
    spark.createDataFrame([], schema).write.mode("append").parquet(source)
    assert counting.latest(spark, out, state, table()).count() == 0
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.mode("append").parquet(source)
    assert sorted(map(tuple, counting.latest(spark, out, state, table()).collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, counting.latest(spark, out, state, table()).collect())) == [("a", 1), ("b", 2)]
    spark.createDataFrame([("a", 5)], schema).write.mode("append").parquet(source)
    assert sorted(map(tuple, counting.latest(spark, out, state, table()).collect())) == [("a", 6), ("b", 2)]


def test_tallies_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "3M2I1D4=1X5S2H"), (2, "*"), (3, None), (4, ""), (5, "M"), (6, "0M12=")], "id int, cigar string")
    got = {x.id: tuple(x)[1:] for x in sequences.tallies(df).collect()}
    assert got[1] == (15, 9, 11, 3, 4, 1) and got[6] == (12, 12, 12, 0, 12, 0)
    assert all(got[k] == (None,) * 6 for k in (2, 3, 4, 5))


def test_sets_of_intervals(spark, monkeypatch):
    monkeypatch.setattr(stats, "STRETCH", 40)
    r = random.Random(2)
    lists = [[(r.choice("xy"), b := r.randint(-20, 200), b + r.randint(0, 8)) for _ in range(80)] for _ in range(2)]
    a, b = (spark.createDataFrame(x + [(None, 1, 5), ("x", None, 5)], "grp string, bgn long, end_ long").filter("grp is not null") for x in lists)
    spots = [{(g, p) for g, s, e in x for p in range(s, e)} for x in lists]
    for name, want in {"union": spots[0] | spots[1], "intersection": spots[0] & spots[1], "difference": spots[0] - spots[1], "either": spots[0] ^ spots[1]}.items():
        got = intervals.combined(a, b, name).collect()
        assert Counter((x.grp, p) for x in got for p in range(x.bgn, x.end_)) == Counter(want), name
        assert not {(x.grp, x.end_) for x in got} & {(x.grp, x.bgn) for x in got}
    within = sorted((x.grp, x.bgn, x.end_) for x in intervals.contained(a, b, 4).collect())
    assert within == sorted(x for x in lists[0] if x[1] < x[2] and all((x[0], p) in spots[1] for p in range(x[1], x[2])))
    assert intervals.combined(a.limit(0), b.limit(0), "union").count() == 0


def test_streams_of_codes(spark):
    from strandq.functions import codes

    r = random.Random(1)
    rows = [(i, [r.choice([1, 2, 3, 7, 100, 2**20, 2**31 - 1]) if i % 2 else r.randint(1, 60) for _ in range(r.randint(0, 12))]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, x array<long>")
    small = df.filter("id % 2 = 0 or x is null")
    for data, kinds in [(small, ["unary"]), (df, ["gamma"]), (df, ["delta"]), (df, ["zeckendorf"]), (df, [("fixed", 31)]), (small, ["gamma", ("fixed", 6), "unary", "zeckendorf", "delta"])]:
        for x in data.select("x", codes.decoded(codes.encoded(F.col("x"), *kinds), *kinds).alias("y")).collect():
            assert x.x == x.y, kinds
    odd = spark.createDataFrame([("",), (None,), ("0",), ("001",), ("0101",), ("x",), ("1" * 5,)], "b string")
    got = [x[0] for x in odd.select(codes.decoded(F.col("b"), "gamma")).collect()]
    assert got == [[], None, None, None, [2, 1], None, [1] * 5]
    assert codes.decode("0" * 70 + "1" + "0" * 70, [("gamma", 0)]) is None
    with pytest.raises(ValueError):
        codes.decoded(F.col("b"), ("fixed", 0))


def test_values_of_kept_alleles(spark):
    from strandq.operators import records

    r = random.Random(7)
    for ploidy in (1, 2, 3):
        rows = []
        for i in range(40):
            n = r.randint(1, 5)
            kept = [0] + sorted(r.sample(range(1, n), r.randint(0, n - 1)))
            order = sorted(itertools.combinations_with_replacement(range(n), ploidy), key=lambda g: g[::-1])
            values = [r.randint(0, 99) for _ in order]
            new = sorted(itertools.combinations_with_replacement(kept, ploidy), key=lambda g: g[::-1])
            rows.append((i, n, kept, values, [values[order.index(g)] for g in new], list(range(100, 100 + n)), [100 + k for k in kept], list(range(n - 1)), [k - 1 for k in kept if k]))
        df = spark.createDataFrame(rows + [(99, 3, [0, 1], [1], None, [1], None, [1], None), (98, 3, [0], None, None, None, None, None, None)], "id int, n int, kept array<int>, g array<int>, g2 array<int>, r array<int>, r2 array<int>, a array<int>, a2 array<int>")
        of = lambda c, number: records.values_of_kept(F.col(c), F.col("kept"), F.col("n"), number, ploidy).alias("new_" + c)
        for x in df.select("*", of("g", "G"), of("r", "R"), of("a", "A")).collect():
            assert (x.new_g, x.new_r, x.new_a) == (x.g2, x.r2, x.a2), (ploidy, x)


def test_pairing_of_allele_sets(spark):
    from strandq.operators import pairing

    pair = lambda rows, *rules: [[s for s, *_ in x] for x in pairing.paired_sets([(s, ref, tuple(a.split(",")), 1) for s, ref, a in rows], frozenset(rules))]
    assert pair([(1, "A", "C,G"), (2, "A", "C")]) == [[1, 2]] and pair([(1, "A", "C,G"), (2, "A", "C")], "exact") == [[1], [2]]
    assert pair([(1, "A", "C,G"), (2, "a", "g,c")], "exact") == [[1, 2]] and pair([(1, "A", "C"), (2, "A", "T")]) == [[1], [2]]
    assert pair([(1, "A", "C"), (2, "A", "T")], "snps") == [[1, 2]] and pair([(1, "A", "C"), (2, "AC", "A")], "snps", "indels") == [[1], [2]]
    assert pair([(1, "A", "C"), (2, "AC", "A")], "any") == [[1, 2]] and pair([(1, "A", "."), (2, "A", "T")], "snp_ref") == [[1, 2]]
    assert pair([(1, "A", "C"), (2, "A", "C"), (3, "A", "C,T"), (3, "A", "G")], "snps") == [[1, 2, 3], [3]]
    # A record that two others suit goes to the one whose alleles agree.
    assert sorted(pair([(1, "A", "C"), (2, "A", "G"), (2, "A", "C,T")], "snps")) == [[1, 2], [2]]

    def plain(rows, rules):
        """The greedy search by plain loops over all pairs of sets."""
        own = {s: tuple(sorted(tuple(v) for t, *v in rows if t == s)) for s, *_ in rows}
        sets = []
        for s, *v in sorted(rows):
            same = next((x for x in sets if x["v"] == [v]), None)
            if same:
                same["s"].append(s)
            else:
                sets.append({"v": [v], "s": [s]})
        done = []
        while sets:
            most = max(len(x["s"]) for x in sets)
            top = next(x for x in sets if len(x["s"]) == most)
            options = []
            for x in sets:
                if x is top or {own[s] for s in x["s"]} & {own[s] for s in top["s"]}:
                    continue
                value = None
                for a in top["v"]:
                    for b in x["v"]:
                        p = pairing._score((a[0], tuple(a[1])), (b[0], tuple(b[1])), rules)
                        if value in (None, "ok") and p == 9:
                            value = "sure"
                        elif value in (None, "ok") and p == 0:
                            value = "no"
                        elif value is None:
                            value = "ok"
                low = min(pairing._score((a[0], tuple(a[1])), (b[0], tuple(b[1])), rules) for a in top["v"] for b in x["v"])
                if value == "sure":
                    options.append(((9, 0), x))
                elif value == "ok":
                    options.append(((low, len(top["s"]) + len(x["s"])), x))
            if not options:
                done.append(sorted(top["s"]))
                sets = [x for x in sets if x is not top]
                continue
            best = max(o[0] for o in options)
            other = next(x for o, x in options if o == best)
            first, second = sorted((top, other), key=lambda x: next(i for i, y in enumerate(sets) if y is x))
            first["v"], first["s"] = first["v"] + second["v"], first["s"] + second["s"]
            sets = [x for x in sets if x is not second]
        return done

    r = random.Random(3)
    rows = []
    for pos in range(250):
        for s in (1, 2, 3):
            for ref, alts in {(r.choice(["A", "AC"]), ",".join(sorted(r.sample(["C", "G", "T", "AT", "."], r.randint(1, 2))))) for _ in range(r.randint(0, 2))}:
                rows.append((pos, s, ref, alts.split(",")))
    for rules in ((), ("exact",), ("snps",), ("snps", "indels", "snp_ref"), ("any",)):
        frames = [spark.createDataFrame([("c", p, ref, alts) for p, t, ref, alts in rows if t == s] + [(None, 1, "A", ["C"]), ("c", 999, "A", None)], "chrom string, pos int, ref string, alts array<string>") for s in (1, 2, 3)]
        got = defaultdict(list)
        for x in pairing.paired(frames, *rules).orderBy("pos", "nth").collect():
            got[x.pos].append(x.sources)
        assert got.pop(999) == [[1, 2, 3]]
        want = {p: plain([(s, ref, tuple(a)) for q, s, ref, a in rows if q == p], frozenset(rules)) for p in {x[0] for x in rows}}
        assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, x in want.items()}, rules
    twice = spark.createDataFrame([("c", 1, "A", ["C"])] * 2, "chrom string, pos int, ref string, alts array<string>")
    assert [x.sources for x in pairing.paired([twice, twice.limit(1)]).orderBy("nth").collect()] in ([[1, 2], [1]], [[1], [1, 2]])
    with pytest.raises(ValueError):
        pairing.paired([twice], "some")


def test_pieces_over_batches(spark, tmp_path):
    """Pieces in any order over batches and restarts, repeated, and sequences that are given up."""
    from strandq.streaming import carry

    schema, base = "seq_idx long, chunk long, piece string, is_last boolean, ts timestamp", f"file://{tmp_path}"
    r = random.Random(4)
    reads = {i: "".join(r.choice("ACGTacgtN") for _ in range(r.randint(1, 60))) for i in range(12)}
    pieces = [(i, n, t[n * 7 : n * 7 + 7], (n + 1) * 7 >= len(t)) for i, t in reads.items() for n in range((len(t) + 6) // 7)]
    r.shuffle(pieces)
    half = len(pieces) // 2
    put = lambda rows, s: spark.createDataFrame([(*x, None) for x in rows], schema).withColumn("ts", F.timestamp_seconds(F.lit(s))).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    def run(name, df):
        df.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/{name}").collect()

    put(pieces[:half], 1000)
    run("led", carry.carried(stream(), 4))
    counting.count_chunks(spark, stream(), 5, f"{base}/k", f"{base}/k-state")
    put([p for p in pieces[half:] if p] + pieces[:2] + [(None, 0, "A", False)], 1001)
    got = defaultdict(list)
    for x in sorted(run("led", carry.carried(stream(), 4))):
        got[x.seq_idx].append(x)
        assert x.lead == reads[x.seq_idx][: x.bgn][-4:]
    whole = {i: "".join(x.piece for x in sorted(v, key=lambda y: y.chunk)) for i, v in got.items()}
    ended = {p[0] for p in pieces[:half] if p[3]}
    assert all(whole[i] == t for i, t in reads.items() if i not in {p[0] for p in pieces[:2]} or i not in ended)
    found = {x.kmer: x.value for x in counting.count_chunks(spark, stream(), 5, f"{base}/k", f"{base}/k-state").collect()}
    assert found == {x.kmer: x.value for x in kmers.count(spark.createDataFrame(list(reads.items()), "seq_idx long, bases string"), 5).collect()}
    squeezed = defaultdict(dict)
    for x in run("squeezed", carry.squeezed(stream())):
        squeezed[x.seq_idx][x.chunk] = x.piece
    for i, t in reads.items():
        assert "".join(v for _, v in sorted(squeezed[i].items())) == re.sub(r"(?i)(.)\1+", r"\1", t)
    # A sequence that the watermark has left behind begins anew.
    put([(50, 0, "AAAA", False)], 2000)
    put([(51, 0, "C", True)], 9000)
    put([(51, 0, "C", True)], 9001)
    put([(50, 0, "GG", True)], 9002)
    late = [x for x in run("late", carry.carried(stream().withWatermark("ts", "1 second"), 4, expire_s=60)) if x.seq_idx == 50]
    assert sorted((x.chunk, x.bgn, x.lead, x.piece) for x in late) == [(0, 0, "", "AAAA"), (0, 0, "", "GG")]


def test_calls_of_samples(spark, tmp_path):
    from strandq.sources import sequence_files as S

    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "x\ty\n1\t5\t.\tA\tC,G\t.\t.\t.\tGT:AD:DP\t0/1:3,4:7\t1\n1\t6\t.\tA\tC\t.\t.\t.\n")
    (tmp_path / "b.vcf").write_text(head + "z\n2\t7\t.\tT\t.\t.\t.\t.\tGT\t./.\n")
    got = sorted((r.chrom, r.pos, r.alt, r["sample"], r.call) for r in S.read_vcf_calls(spark, f"file://{tmp_path}").collect())
    assert got == [("1", 5, ["C", "G"], "x", {"GT": "0/1", "AD": "3,4", "DP": "7"}), ("1", 5, ["C", "G"], "y", {"GT": "1", "AD": None, "DP": None}), ("2", 7, ["."], "z", {"GT": "./."})]
    reads = spark.createDataFrame([("r", "ACGTACGT", "ABCDEFGH")], "ident string, bases string, quals string")
    asked = spark.createDataFrame([("r:3-6",), ("r",), ("q",)], "region string")
    assert {x.region: x.bases for x in S.fetch(S.sequence_table(reads, 4, "quals"), asked, 4).collect()} == {"r:3-6": "CDEF", "r": "ABCDEFGH", "q": None}


def test_common_fronts(spark):
    rows = [("ACG", ["ACT", "AC"], 2), ("ACG", ["T"], 0), ("A", ["AC"], 1), ("AC", None, 2), ("AC", [], 2), ("AC", ["<DEL>"], 0), ("AC", ["AC"], 2), ("AC", [""], 0)]
    df = spark.createDataFrame(rows, "ref string, alts array<string>, n int")
    assert all(x.n == x.m for x in df.select("n", intervals.common_front(F.col("ref"), F.col("alts")).alias("m")).collect())


def test_ranks_of_a_group_over_many_stretches(spark):
    """One group of very many different values lies in several stretches, and its ranks are those of one sorted list."""
    rnd = random.Random(3)
    values = [("a", rnd.choice([rnd.random(), float(rnd.randrange(50))])) for _ in range(4000)] + [(None, 2.0), (None, 5.0), (None, 9.0), ("n", None)]
    df = spark.createDataFrame(values, "grp string, x double")
    got = stats.counted(df).collect()
    want = sorted(v for g, v in values if g == "a")
    assert sorted((r.x, r.cum) for r in got if r.grp == "a") == [(v, sum(w <= v for w in want)) for v in sorted(set(want))]
    assert {(r.grp, r.n) for r in got} == {("a", 4000), (None, 3), ("n", 1)}
    assert stats.ordered_cells(df.filter("grp = 'a'"), "x").select("cell").distinct().count() > 2
    assert {r.grp: r["median"] for r in stats.median(df).collect()} == {"a": (want[1999] + want[2000]) / 2, None: 5.0}
    assert stats.counted(df.limit(0)).count() == 0


HEADER = ['##fileformat=VCFv4.2', '##source=a=b', '##source=second', r'##INFO=<ID=DP,Number=1,Type=Integer,Description="a, \"b\" \\ >">', '##FILTER=<ID=q10,Description="">', '##META=<Note=x>', '#CHROM\tPOS', None, '']
OTHER = ['##source=other', '##INFO=<ID=DP,Number=.,Type=Integer,Description="later">', '##FILTER=<ID=q10,Description="later">', '##META=<Note=y>', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">', '##extra=1']


def _headers(spark, *lists):
    return headers.parsed(spark.createDataFrame([(i, j, x) for i, some in enumerate(lists) for j, x in enumerate(some)], "source int, nth int, line string"))


def test_headers_are_written_as_they_were(spark):
    sam = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:100\tUR:file:/a", "@CO\tfree\ttext", "@RG\tID:r1\tSM:s"]
    got = _headers(spark, HEADER, OTHER, sam).select("source", "nth", "kind", "id", headers.written().alias("line")).orderBy("source", "nth").collect()
    assert [r.line for r in got] == HEADER[:6] + OTHER + sam
    assert [r.id for r in got if r.source == 2] == [None, "chr1", None, "r1"]
    about = _headers(spark, HEADER).filter("id = 'DP'").select(headers.field(F.col("fields"), "Description")).first()[0]
    assert about == 'a, "b" \\ >'


def test_one_header_of_two(spark):
    out = headers.merged(_headers(spark, HEADER, OTHER)).select("*", headers.written().alias("line")).collect()
    assert {r.line: r.differs for r in out} == {x: x.startswith("##INFO") for x in HEADER[:6] + OTHER[-2:]} and len(out) == 8
    assert headers.merged(_headers(spark, [])).count() == 0
    many = headers.merged(_headers(spark, *[["##note=x", "##INFO=<ID=A,Number=1,Type=Flag>", "@CO\tc"]] * 2000)).collect()
    assert sorted((r.mark, r.kind, r.source) for r in many if r.mark == "##") == [("##", "INFO", 0), ("##", "note", 0)] and len(many) == 2002


def test_headers_edited_and_cut(spark):
    rows = _headers(spark, HEADER, OTHER)
    f = F.col("fields")
    put = headers.with_field(headers.with_field(f, "Number", F.lit("A")), "Source", F.lit('x"y'), quoted=True)
    line = rows.filter("kind = 'FORMAT'").withColumn("fields", put).select(headers.written()).first()[0]
    assert line == '##FORMAT=<ID=DP,Number=A,Type=Integer,Description="d",Source="x\\"y">'
    gone = rows.filter("kind = 'META'").withColumn("fields", headers.with_field(f, "Note", F.lit(None).cast("string"))).select(headers.written()).distinct().collect()
    assert [r[0] for r in gone] == ["##META=<>"]
    ids = spark.createDataFrame([("DP",), (None,)], "id string")
    assert headers.with_ids(rows, "INFO", ids, keep=False).filter("kind = 'INFO'").count() == 0
    assert headers.with_ids(rows, "INFO", ids).count() == rows.count()
    assert headers.with_ids(rows, "META", ids).filter("kind = 'META'").count() == 0


def test_tags_of_types(spark):
    df = spark.createDataFrame([({"NM": "3", "ZZ": "a:b", "XB": "f,1.5,-2"},), ({},), (None,)], "tags map<string,string>")
    got = df.select(records.tag_set(F.col("tags"), "NM", F.lit(None).cast("string")).alias("a"), records.tag_set(F.col("tags"), "NM", F.lit(4)).alias("b"), records.tag_numbers(F.try_element_at("tags", F.lit("XB"))).alias("n"), records.tag_numbers(F.try_element_at("tags", F.lit("ZZ"))).alias("z")).collect()
    assert got[0].a == {"ZZ": "a:b", "XB": "f,1.5,-2"} and got[0].b["NM"] == "4" and got[0].n == [1.5, -2.0] and got[0].z == [None]
    assert got[1].a == {} and got[1].b == {"NM": "4"} and got[1].n is None and got[2].a is None
