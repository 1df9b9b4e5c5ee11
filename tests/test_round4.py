"""Work that is done for many rows at once gives what is given for each alone."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandq.operators import alignment, intervals, piles, qualities, sequences, stats
from strandq.plans import registry
from strandq.sources import shared


def some_reads(spark, n=300, letters="ACGTN"):
    r = random.Random(5)
    text = lambda k, of: "".join(r.choice(of) for _ in range(k))
    out = []
    for i in range(n):
        ops = [(r.choice((0, 1, 3, 9, 300)), r.choice("MIDNSHP=X")) for _ in range(r.randrange(1, 7))]
        size = sum(k for k, op in ops if op in "MIS=X") + r.choice((0, 0, 0, -2))
        cigar = r.choice(("*", None, "3", "M")) if i % 17 == 0 else "".join(f"{k}{op}" for k, op in ops)
        out.append((f"c{i % 2}", "s" if i % 3 else None, None if i % 29 == 0 else r.randrange(-300, 600), cigar, None if i % 13 == 0 else text(max(0, size), letters), None if i % 11 == 0 else text(max(0, size), "!5I~"), i % 2))
    return spark.createDataFrame(out, "chrom string, sample string, pos long, cigar string, seq string, qual string, strand int")


@pytest.mark.parametrize("letters", ["ACGTN", "ACGT\0é中😀"])
def test_packed_pileups_are_the_columns_counted_one_by_one(spark, letters):
    reads = some_reads(spark, letters=letters)
    plain = sequences.covered(reads, "sample").groupBy("sample", "chrom", "pos", "base", "inserted").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))
    piled = sequences.pileup(reads, "sample")
    assert piled.dtypes == plain.dtypes
    assert sorted(map(tuple, piled.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_a_bin_that_is_counted_together_stays_small():
    reads = pa.table({"chrom": ["a"] * 5000, "pos": [250] * 5000, "cigar": ["10M"] * 5000, "seq": ["ACGTACGTAC"] * 5000, "qual": ["I" * 10] * 5000})
    packed = pa.Table.from_batches([piles._packed(reads, ["chrom"], True)] * 40)
    one = piles._compact(packed, ["chrom"])
    assert one.num_rows == 2 and len(piles.entries(one, ["chrom"])[0]) == 10
    assert (piles.entries(one, ["chrom"])[4] == 200_000).all()


def test_likelihoods_of_reads_are_those_of_their_bases(spark):
    reads = some_reads(spark)
    deep = spark.range(900).selectExpr("'d' as chrom", "'s' as sample", "id % 3 as pos", "'4M' as cigar", "if(id % 5 = 0, 'ACGT', 'AAGN') as seq", "if(id % 2 = 0, 'I#5~', '!!II') as qual", "cast(id % 2 as int) as strand")
    reads = reads.unionByName(deep)
    got = {x[:3]: x[3:] for x in map(tuple, qualities.read_likelihoods(reads, "sample").collect())}
    plain = {x[:3]: x[3:] for x in map(tuple, qualities.genotype_likelihoods(sequences.covered(reads, "sample", "strand"), "sample").collect())}
    assert got.keys() == plain.keys() and any(x[0] > qualities.HELD for x in got.values())
    for k in got:
        assert got[k][0] == plain[k][0] and got[k][1] == pytest.approx(plain[k][1], abs=1e-9)


def test_likelihoods_of_many_positions_are_those_of_each():
    r = np.random.default_rng(3)
    counts = {p: {(int(r.integers(4, 64)), int(r.integers(2)), int(r.integers(4))): int(r.integers(1, 30 if p % 7 else 300)) for _ in range(int(r.integers(1, 12)))} for p in range(60)}
    columns = np.array([(p, *k, n) for p, some in counts.items() for k, n in some.items()])
    depth, found = qualities.likelihoods_of_many(*columns.T)
    assert depth.max() > qualities.HELD
    for p, some in counts.items():
        assert found[p] == pytest.approx(qualities.likelihoods_of([(*k, n) for k, n in some.items()]), abs=1e-7)


@pytest.mark.parametrize("mode", ["local", "extend", "dovetail", "contained"])
def test_pairs_aligned_together_are_as_aligned_alone(mode):
    r = random.Random(7)
    text = lambda k: "".join(r.choice("ACGTNé") for _ in range(k))
    pairs = [(text(r.choice((0, 1, 2, 30))), text(r.choice((0, 1, 3, 40)))) for _ in range(150)]
    pairs += [(a, a[3:9] + text(20) + a[15:]) for a in (text(40) for _ in range(60))] + [(text(600), text(20))]
    for costs in ({}, {"opening": 1, "extending": 1, "match": 3, "mismatch": 1}):
        assert alignment.affine_many(pairs, mode, **costs) == [alignment.affine(a, b, mode, **costs) for a, b in pairs]


def test_tasks_of_sweeps_grow_with_the_rows(spark, monkeypatch):
    r = random.Random(11)
    some = lambda n: [("a" if r.random() < 0.8 else "b", at := r.randrange(30_000), at + r.randrange(12)) for _ in range(n)]
    left, right = some(3000), some(2500)
    a, b = (spark.createDataFrame(x, "grp string, bgn long, end_ long") for x in (left, right))
    plain = {name: sorted(map(tuple, intervals.combined(a, b, name).collect())) for name in intervals.OPERATIONS}
    whole = sorted(map(tuple, intervals.squash(a).collect()))
    holes = sorted(map(tuple, intervals.invert(intervals.squash(a), 100, 5000).collect()))
    monkeypatch.setattr(stats, "STRETCH", 100)
    assert intervals.squash(a).rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, intervals.squash(a).collect())) == whole
    assert sorted(map(tuple, intervals.invert(intervals.squash(a), 100, 5000).collect())) == holes
    spots = lambda rows: {(g, p) for g, lo, hi in rows for p in range(lo, hi)}
    x, y = spots(left), spots(right)
    for name, own in {"union": x | y, "intersection": x & y, "difference": x - y, "either": x ^ y}.items():
        got = sorted(map(tuple, intervals.combined(a, b, name).collect()))
        assert got == plain[name] and spots(got) == own
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_no_task_writes_a_fixed_share_of_a_streamed_table(spark):
    source = registry.streamed(spark, "/root/testdata/sf0.001", "documents")
    written = spark.read.parquet(next(x for x in reversed(shared.made(spark))))
    assert source.isStreaming and len(written.inputFiles()) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
