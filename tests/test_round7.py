"""What large tables put on disk: rows are shuffled once, packed or as they are, not with what is made of them."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandq.operators import intervals, kmers, packed, piles, sequences, stats
from strandq.plans import registry, sequence_queries  # noqa: F401  registers more
from strandq.sources import shared

SF = "/root/testdata/sf0.001"


def test_reads_are_shuffled_not_their_column_sums(spark):
    plan = registry.queries()["cig03_columns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" not in plan


def test_column_sums_are_those_of_the_columns(spark, monkeypatch):
    r = random.Random(5)
    cigar = lambda: "".join(f"{r.choice((0, 1, 2, 7, 40))}{r.choice('MIDNSHP=X')}" for _ in range(r.randint(1, 9)))
    reads = [(r.choice([None, "a", "b", "c", *map(str, range(90))]), r.choice([cigar(), cigar(), cigar(), "*", None, "", "5S"]), r.choice([None, -3, 0, 10**6])) for _ in range(1500)]
    df = spark.createDataFrame(reads, "id string, cigar string, pos long").repartition(3)
    want = sequences.columns(df).groupBy("id", "op").agg(F.count("*"), F.sum("a_pos"), F.sum("b_pos"), F.sum(F.col("a_pos") * F.col("b_pos")))
    want = sorted(map(tuple, want.collect()), key=str)
    for at_once, share in ((piles.READS_AT_ONCE, piles.READS), (1, 10), (20, 200)):
        monkeypatch.setattr(piles, "READS_AT_ONCE", at_once)
        monkeypatch.setattr(piles, "READS", share)
        with_few = df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            got = sequences.column_sums(df)
            assert got.rdd.getNumPartitions() >= 1500 // share
            assert sorted(map(tuple, got.collect()), key=str) == want
        finally:
            df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_few)
    assert sequences.column_sums(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "9000000M", 0)], "id int, cigar string, pos long")
    with pytest.raises(Exception, match="64 bits"):
        sequences.column_sums(huge).collect()


def plain(texts, k):
    """How often each canonical k-mer occurs, one by one."""
    key, out = (lambda x: x.translate(str.maketrans("ACTG", "0123"))), Counter()
    for t in texts:
        t = (t or "").translate(str.maketrans("acgt", "ACGT"))
        some = [f for p in range(len(t) - k + 1) if not set(f := t[p : p + k]) - set("ACGT")]
        out.update(min(f, f[::-1].translate(str.maketrans("ACGT", "TGCA")), key=key) for f in some)
    return out


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(9)
    some = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = [some(r.randrange(150), "ACGTacgtN" if r.random() < 0.3 else "ACGT") for _ in range(60)] + [None, "", "A", "N" * 40, "A" * 900, "AC" * 400, some(700, "AT"), "é" + some(80, "ACGT")]
    line = some(90, "ACGT")
    return texts + texts[:20] + [some(15, "ACGT") + line + some(15, "ACGT") for _ in range(25)] + [line[::-1].translate(str.maketrans("ACGT", "TGCA"))]


@pytest.mark.parametrize("k", [15, 16, 21, 29, 30, 31, 32, 33, 47, 48, 49, 63, 64])
def test_runs_of_windows_give_every_kmer(spark, monkeypatch, odd_texts, k):
    own = plain(odd_texts, k)
    reads = spark.createDataFrame(list(enumerate(odd_texts)), "seq_idx long, bases string").repartition(3)
    for block, held in ((kmers.BLOCK, kmers.HELD), (100, 7)):
        monkeypatch.setattr(kmers, "BLOCK", block)
        monkeypatch.setattr(kmers, "HELD", held)
        for least in (1, 2):
            rows = kmers.count(reads, k, least=least).collect()
            assert len(rows) == len({x.kmer for x in rows})
            assert {x.kmer: x.value for x in rows} == {x: n for x, n in own.items() if n >= least}


@pytest.mark.parametrize("k", [21, 40])
def test_a_cell_is_counted_in_passes(monkeypatch, odd_texts, k):
    """What tasks do, in this process, so that its settings hold."""
    monkeypatch.setattr(kmers, "BLOCK", 60)
    digits = kmers.DIGITS[np.frombuffer("\n".join(t or "" for t in odd_texts).encode(), np.uint8)]
    rows = []
    for lo in range(0, len(digits) - k + 1, kmers.BLOCK):
        batch = kmers._runs(digits[lo : lo + kmers.BLOCK + k - 1], k)
        rows += zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
    for held in (1 << 23, 997):
        monkeypatch.setattr(kmers, "HELD", held)
        got = [x for batch in kmers._passes(rows, k, 1) for x in zip(*batch.to_pydict().values(), strict=True)]
        assert len(got) == len(dict(got)) and dict(got) == plain(odd_texts, k)


def test_a_window_takes_few_bytes_of_a_shuffle(spark, monkeypatch):
    """Of new text, and of text that a block has several times."""
    r = random.Random(4)
    new, caught = "".join(r.choices("ACGT", k=400_000)), []
    for texts, most in (([new], 2.5), ([new[:20_000]] * 20, 0.2)):
        reads = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, bases string").coalesce(1)
        with monkeypatch.context() as m:
            m.setattr(type(reads), "repartition", lambda self, *a, f=type(reads).repartition: caught.append(self) or f(self, *a))
            kmers.count(reads, 21)
        binary = [F.sum(F.length(c)) for c, kind in caught[-1].dtypes if kind == "binary"]
        assert sum(caught[-1].agg(*binary).first()) < most * 400_000


def test_numbers_come_back_from_their_bytes():
    r = np.random.default_rng(1)
    for x in ([], [0, 0, 0], [1, -1, 300, 2**63 - 1, -(2**63)], r.integers(-3, 3, 900), r.integers(-(2**40), 2**40, 900)):
        x = np.array(x, np.int64)
        rows = packed.packed(x, np.array([0, len(x) // 3, len(x) // 3, len(x)]))
        assert [packed.numbers(y).tolist() for y in rows.to_pylist()] == [x[: len(x) // 3].tolist(), [], x[len(x) // 3 :].tolist()]


@pytest.mark.parametrize("name", ["int09_union", "int09_difference", "int09_either", "int09_intersection"])
def test_sets_of_intervals_are_shuffled_once(spark, monkeypatch, name):
    """Ends of intervals in packed rows; groups that fit a task leave no table in the scratch folder."""
    caught, made = [], len(shared.made(spark))
    frame = type(spark.range(0))
    with monkeypatch.context() as m:
        m.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: caught.append(self) or f(self, *a))
        found = registry.queries()[name](spark, SF)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert len(shared.made(spark)) == made
    ends = 4 * spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(caught[-1].agg(*(F.sum(F.length(c)) for c in ("sizes", "pos", "a", "b"))).first()) < 4 * ends


def covered(rows, operation):
    """The intervals of an operation, from how many of both lists are open at each place."""
    out = []
    for g in sorted({x[0] for x in rows[0] + rows[1] if x[0] is not None}):
        moves = Counter()
        for side, own in enumerate(rows):
            for h, lo, hi in own:
                if h == g and lo is not None and hi is not None and lo < hi:
                    moves[lo, side] += 1
                    moves[hi, side] -= 1
        depth, begin = [0, 0], None
        for pos in sorted({p for p, _ in moves}):
            for side in (0, 1):
                depth[side] += moves[pos, side]
            a, b = depth[0] > 0, depth[1] > 0
            on = {"union": a or b, "intersection": a and b, "difference": a and not b, "either": a != b}[operation]
            if on and begin is None:
                begin = pos
            elif not on and begin is not None:
                out.append((g, begin, pos))
                begin = None
    return out


@pytest.mark.parametrize("operation", ["union", "intersection", "difference", "either"])
def test_sets_of_large_groups_are_put_together_of_stretches(spark, monkeypatch, operation):
    r = random.Random(6)
    day = lambda: datetime.date(2020, 1, 1 if r.random() < 0.7 else r.randint(2, 9))
    some = lambda n: [(day(), at := r.randint(-500, 500), at + r.choice((-2, 0, 1, 4, 9))) for _ in range(n)]
    lists = [some(500) + [(None, 1, 9), (day(), None, 3), (day(), 4, None)], some(300)]
    lists[0] += [(datetime.date(2020, 1, 1), -10_000, 10_000)] * 2 + [(datetime.date(2020, 1, 1), 600, 650), (datetime.date(2020, 1, 1), 650, 700)] * 9
    lists[1] += [(datetime.date(2020, 1, 2), 0, 2**63 - 1), (datetime.date(2020, 1, 1), -(2**63), -400), (datetime.date(2020, 1, 1), 640, 20_000)]
    a, b = (spark.createDataFrame(x, "grp date, bgn long, end_ long").repartition(2) for x in lists)
    want = covered(lists, operation)
    for stretch, pack, sample in ((stats.STRETCH, intervals.PACK, intervals.SAMPLE), (150, 60, intervals.SAMPLE), (150, 1000, 16)):
        monkeypatch.setattr(stats, "STRETCH", stretch)
        monkeypatch.setattr(intervals, "PACK", pack)
        monkeypatch.setattr(intervals, "SAMPLE", sample)
        assert sorted(map(tuple, intervals.combined(a, b, operation).collect())) == want
    assert intervals.combined(a.limit(0), b.limit(0), operation).count() == 0


def test_groups_and_ids_of_other_types(spark, monkeypatch):
    """Structs, and numbers of which Spark groups 0.0 with -0.0, and NaN with NaN; groups that fit a task, and such that are cut."""
    spans = [(g, at, at + 3) for g in (0, 1, 2) for at in range(g, 90, 2 + g)]
    for as_, kind in ((lambda g, at: {"x": g, "y": None}, "struct<x:int,y:string>"), (lambda g, at: (0.0 if at % 4 else -0.0, 1.5, float("nan"))[g], "double")):
        a = spark.createDataFrame([(as_(g, x), x, y) for g, x, y in spans], f"grp {kind}, bgn long, end_ long")
        reads = spark.createDataFrame([(as_(g, x), f"{x + 1}M2D", y) for g, x, y in spans], f"id {kind}, cigar string, pos long").repartition(2)
        want = sequences.columns(reads).groupBy("id", "op").agg(F.count("*"), F.sum("a_pos"), F.sum("b_pos"), F.sum(F.col("a_pos") * F.col("b_pos")))
        whole = sorted((str(x.grp), x.bgn, x.end_) for x in intervals.squash(a).collect())
        for stretch, at_once in ((stats.STRETCH, piles.READS_AT_ONCE), (30, 3)):
            monkeypatch.setattr(stats, "STRETCH", stretch)
            monkeypatch.setattr(piles, "READS_AT_ONCE", at_once)
            assert sorted((str(x.grp), x.bgn, x.end_) for x in intervals.combined(a, a.limit(0), "union").collect()) == whole
            assert sorted(map(str, map(tuple, sequences.column_sums(reads).collect()))) == sorted(map(str, map(tuple, want.collect())))
