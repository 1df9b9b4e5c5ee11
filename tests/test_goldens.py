"""Literal goldens and round trips for the library's own operators."""

from pyspark.sql import functions as F

from strandq.functions import bases as B
from strandq.functions import bits, random_numbers, text
from strandq.operators import alignment, intervals, kmers, records, sequences, stats
from strandq.sources import sequence_files as S


def col(spark, sql, *columns):
    return [tuple(r) for r in spark.sql(sql).select(*columns).collect()]


def test_kmers(spark):
    got = dict(col(spark, "select explode(array('ACGT','AAAC','GTTT','GGGA','TGAC')) m", "m", B.canonical(F.col("m"))))
    assert got == {"ACGT": "ACGT", "AAAC": "AAAC", "GTTT": "AAAC", "GGGA": "TCCC", "TGAC": "TGAC"}
    got = {m: int(v) for m, v in col(spark, "select explode(array('ACGT','AAAC','GTTT','GGGA','TGAC')) m", "m", B.packed(F.col("m")))}
    assert got == {"ACGT": 30, "AAAC": 1, "GTTT": 234, "GGGA": 252, "TGAC": 177}
    short = spark.createDataFrame([(1, "ACG"), (2, ""), (3, None), (4, "ACNGT")], "seq_idx long, bases string")
    assert kmers.count(short, 4).count() == 0
    assert tuple(kmers.census(spark, 4).first()) == (16, 120)
    table = spark.range(300).selectExpr("cast(id as string) as kmer", "id % 7 + 1 as value")
    assert [tuple(r) for r in kmers.lookup_sizes(table, 8, 70_000).orderBy("prefix_bits").collect()] == [(6, 7996, True, False), (7, 11792, False, False), (8, 19684, False, False), (9, 35768, False, True)]
    assert kmers.lookup_sizes(table.limit(0), 8).count() == 0


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 7, 4), (1, 0, 10), (1, 8, 12)], "grp long, a long, n long")
    assert [tuple(r) for r in intervals.squash(intervals.from_span(spans, "a", "n"), -1).collect()] == [(1, 0, 20, 3)]
    iv = spark.createDataFrame([(1, -30, -10), (1, -5, 5), (1, 10, 30)], "grp long, bgn long, end_ long")
    assert {(r.bgn, r.end_) for r in intervals.invert_each(iv, -20, 20).collect()} == {(-10, 20), (-20, -5), (5, 20), (-20, 10)}
    d = spark.createDataFrame([(1, 1, 4), (1, 2, 6)], "grp long, bgn long, end_ long")
    assert sorted(tuple(r)[1:] for r in intervals.depth(d).collect()) == [(1, 2, 1), (2, 4, 2), (4, 6, 1)]


def test_statistics(spark):
    x = spark.createDataFrame([(1, v) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "grp long, x long")
    r = stats.moments(x).first()
    assert r.mean == 5 and abs(r.variance - 32 / 7) < 1e-12
    signed = spark.createDataFrame([(1, v, w) for w in (1, -1) for v in (1, 2, 3, 4, 9, 8, 7, 6, 20, 30)], "grp long, x long, w long")
    assert tuple(stats.retract(signed).first()) == (1, 0, 0.0, 0.0)
    assert stats.mode(spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 1)], "grp long, x long")).first()["mode"] == 0
    assert abs(stats.fisher(spark.createDataFrame([(3, 1, 1, 3)], "n11 int, n12 int, n21 int, n22 int")).first()["two"] - 0.4857142857) < 1e-9


def test_texts(spark):
    got = dict(col(spark, "select explode(array('-4','-4k','-4ki','4ki','10h','10hg','45d','45di')) s", "s", text.decode_integer(F.col("s"))))
    assert got == {"-4": -4, "-4k": -4000, "-4ki": -4096, "4ki": 4096, "10h": 16, "10hg": None, "45d": 45, "45di": 45}
    got = [r[0] for r in col(spark, "select array() a union all select array(0L) union all select array(1L,2L,3L)", text.word_hash(F.col("a").cast("array<bigint>")))]
    assert got == [3712491661, 255949886, 3415515932]
    assert [r[0] for r in col(spark, "select id from range(1, 6)", bits.zeckendorf(F.col("id")))] == ["11", "011", "0011", "1011", "00011"]
    heads = col(spark, "select explode(array('name','  name   ','  name   flags','  name   f l a g s    ')) s", text.ident(F.col("s")), text.flags(F.col("s")))
    assert heads == [("name", ""), ("name", ""), ("name", "flags"), ("name", "f l a g s")]


def test_sequences(spark):
    assert col(spark, "select 'AAaCCGTTt' s", B.runs_squeezed(F.col("s")), sequences.squeezed_map(F.col("s"))) == [("ACGT", [0, 0, 0, 1, 1, 2, 3, 3, 3, 4])]


def _cost(a, b, mode, match=2, mismatch=4, opening=4, extending=2):
    """Best score by plain recursion over cells."""
    low, free_a, free_b = -(10**6), mode in ("local", "dovetail"), mode in ("local", "contained")
    first = opening - extending if mode == "local" else opening
    h, e, f = {}, {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            e[i, j] = max(e[i - 1, j], h[i - 1, j] - first) - extending if i else low
            f[i, j] = max(f[i, j - 1], h[i, j - 1] - first) - extending if j else low
            blank = mode == "local" and i and j and "N" in (a[i - 1], b[j - 1])
            step = h[i - 1, j - 1] + (0 if blank else match if a[i - 1] == b[j - 1] else -mismatch) if i and j else low
            begin = 0 if mode == "local" or (not i and not j) or (not j and free_a) or (not i and free_b) else low
            h[i, j] = max(begin, step, e[i, j], f[i, j])
    return max(v for (i, j), v in h.items() if mode in ("local", "extend") or i == len(a))


def _walked(a, b, got, mode):
    """The score of the alignment that a result describes."""
    import re

    score, i, end_a, j, end_b, cigar = got
    total = 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([=XID])", cigar)):
        for _ in range(n if op in "=X" else 0):
            assert (a[i] == b[j]) == (op == "=")
            total += 0 if mode == "local" and "N" in (a[i], b[j]) else 2 if op == "=" else -4
            i, j = i + 1, j + 1
        if op in "ID":
            total -= (2 if mode == "local" else 4) + 2 * n
            i, j = i + n * (op == "I"), j + n * (op == "D")
    assert (i, j) == (end_a, end_b)
    return total


def test_alignment():
    import random

    assert alignment.fit("AACT", "AACTGGC", True)[0] == 0 and alignment.fit("ACT", "CGACTGAC", False)[0] == 0
    r = random.Random(5)
    for mode in ("local", "extend", "dovetail", "contained"):
        for _ in range(150):
            a, b = ("".join(r.choice("ACGTN") for _ in range(r.randint(0, 12))) for _ in "ab")
            got = alignment.affine(a, b, mode)
            assert got[0] == _cost(a, b, mode), (mode, a, b)
            assert _walked(a, b, got, mode) == got[0], (mode, a, b, got)


def test_sweeps_in_stretches(spark, monkeypatch):
    """Squashed intervals, depth and holes of a group that is most of all rows, by plain loops; bins with very long intervals."""
    import random

    r = random.Random(9)
    rows = []
    for _ in range(400):
        g, b = r.choice((1, 1, 1, 2)), r.randint(0, 600)
        rows.append((g, b, b + r.choice((0, 1, 3, 9, 60))))
    iv = spark.createDataFrame(rows, "grp long, bgn long, end_ long")
    for cells in (1, 7, 64):
        monkeypatch.setattr(stats, "STRETCH", -(-len(rows) // cells))
        for least in (-2, 0, 4):
            want = []
            for g in (1, 2):
                reach, out = None, []
                for _, b, e in sorted(x for x in rows if x[0] == g):
                    if reach is not None and (reach >= b + least or e <= reach):
                        out[-1] = (g, min(out[-1][1], b), max(out[-1][2], e), out[-1][3] + 1)
                    else:
                        out.append((g, b, e, 1))
                    reach = e if reach is None else max(reach, e)
                want += out
            assert sorted(map(tuple, intervals.squash(iv, least).collect())) == sorted(want), (cells, least)
        want = []
        for g in (1, 2):
            at = sorted({p for x in rows if x[0] == g for p in x[1:]})
            want += [(g, a, b, sum(x[0] == g and x[1] <= a < x[2] for x in rows)) for a, b in zip(at, at[1:], strict=False)]
        assert sorted(map(tuple, intervals.depth(iv).collect())) == sorted(want), cells
    assert intervals.squash(iv.limit(0)).count() == intervals.depth(iv.limit(0)).count() == 0
    other = [(r.choice((1, 2)), b, b + n) for b, n in ((0, 10**9), (5, 0), (599, 1), *((r.randint(0, 600), r.choice((1, 30, 5000))) for _ in range(80)))]
    right = spark.createDataFrame(other, "grp long, beg2 long, end2 long")
    for closed in (False, True):
        want = [(*x, *y[1:]) for x in rows for y in other if x[0] == y[0] and ((x[1] <= y[2] and x[2] >= y[1]) if closed else (x[1] < y[2] and x[2] > y[1]))]
        assert sorted(map(tuple, intervals.overlaps(iv, right, 4, closed).select("grp", "bgn", "end_", "beg2", "end2").collect())) == sorted(want)


def test_files(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">r1 some flags\nACGT\nAC GT\n>r2\n\n>r3\tverbatim  \nGG\n")
    got = sorted(tuple(r) for r in S.read_fasta(spark, str(p)).collect())
    assert got == [("r1", "some flags", "ACGTACGT"), ("r2", "", ""), ("r3", "verbatim  ", "GG")]
    q = tmp_path / "x.fq"
    q.write_text("@a x\nACG\n+\n!I@\n@b\nAC\n-\n!!\n")
    got = sorted(tuple(r) for r in S.read_fastq(spark, str(q)).collect())
    assert got == [("a", "x", "ACG", [0, 40, 31], 0), ("b", "", "", [], 1)]
    v = tmp_path / "x.vcf"
    v.write_text("##x\n#CHROM\n1\t5\t.\tA\tC,G\t9.5\tPASS\tDP=3;AF=0.1,0.2;DB\n")
    r = S.read_vcf(spark, str(v)).first()
    assert r.alt == ["C", "G"] and r.info == {"DP": ["3"], "AF": ["0.1", "0.2"], "DB": []}
    s = tmp_path / "x.sam"
    s.write_text("@HD\tVN:1\nq1\t16\tchr1\t7\t60\t4M\t*\t0\t0\tAACG\tABCD\tNM:i:1\nq2\t256\tchr1\t7\t60\t4M\t*\t0\t0\tAACG\tABCD\n")
    assert [tuple(r) for r in S.sam_reads(S.read_sam(spark, str(s))).collect()] == [("q1", "CGTT", "DCBA")]


def test_fasta_headers_with_marks(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_bytes(b">r1 a>b\r\nACGT\r\n>r2\nAC\n\nGT\n")
    assert sorted(tuple(r) for r in S.read_fasta(spark, str(p)).collect()) == [("r1", "a>b", "ACGT"), ("r2", "", "ACGT")]


def test_fastq_in_splits(spark, tmp_path):
    """Wherever a file is split, its records are the same: qualities that begin with @ and +, long and short reads."""
    import random

    r = random.Random(3)
    want, text = [], ""
    for i in range(60):
        n = r.choice((1, 3, 40, 300))
        bases, quals = "".join(r.choice("ACGTN") for _ in range(n)), "".join(r.choice("@+!IA") for _ in range(n))
        want.append((f"read{i}", bases, [ord(c) - 33 for c in quals], 0))
        text += f"@read{i} x\n{bases}\n+\n{quals}\n"
    for k in range(2):
        (tmp_path / f"{k}.fq").write_text(text[: len(text) - k])
    try:
        for size in (97, 1000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            got = sorted((x.ident, x.bases, x.quals, x.error) for x in S.read_fastq(spark, str(tmp_path)).collect())
            assert got == sorted(want * 2), size
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_mixed_files(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("junk\n>a one\nAC\nGT\n@b\nACG\n+\n@>I\n\n>c\n@d\nAC\nno plus\n@e\nA\n+x\n!\nlost\n>f\nAA")
    got = {x.ident: (x.bases, x.quals, x.error) for x in S.read_mixed(spark, str(p)).collect()}
    assert got == {"a": ("ACGT", [], 2), "b": ("ACG", [31, 29, 40], 0), "c": ("", [], 0), "d": ("", [], 1), "e": ("A", [0], 2), "f": ("AA", [], 2)}


def test_sniffed_files_and_regions(spark, tmp_path):
    import pytest

    texts = {"fa": ">x y\nACGTACGTAC\nGT\n>z\n", "fq": "@x\nACG\n+\n!!I\n", "sam": "@HD\tVN:1\nx\t16\tc\t7\t60\t3M\t*\t0\t0\tAAC\tABC\n", "two": "@CO x\n@CO y\nx\t0\tc\t7\t60\t3M\t*\t0\t0\tAAC\tABC\n"}
    for k, t in texts.items():
        (tmp_path / k).write_text(t)
    got = {k: [tuple(x) for x in S.open_sequences(spark, str(tmp_path / k)).orderBy("ident").collect()] for k in texts}
    assert got == {"fa": [("x", "ACGTACGTACGT", []), ("z", "", [])], "fq": [("x", "ACG", [0, 0, 40])], "sam": [("x", "GTT", [34, 33, 32])], "two": [("x", "AAC", [32, 33, 34])]}
    (tmp_path / "no").write_text("@x\nACG\n")
    with pytest.raises(ValueError):
        S.sniff(spark, str(tmp_path / "no"))
    reads = S.read_fasta(spark, str(tmp_path / "fa"))
    regions = spark.createDataFrame([(x,) for x in ("x", "x:2-4", "x:5-7", "x:9-99", "x:20-30", "x:4", "z", "none:1-2")], "region string")
    for most in (1, 4, 5, 1 << 16):
        got = {x.region: x.bases for x in S.fetch(S.sequence_table(reads, most), regions, most).collect()}
        assert got == {"x": "ACGTACGTACGT", "x:2-4": "CGT", "x:5-7": "ACG", "x:9-99": "ACGT", "x:20-30": "", "x:4": "TACGTACGT", "z": "", "none:1-2": None}, most
    many = spark.range(1000).repartition(7)
    assert sorted(x.seq_idx for x in S.numbered(many).collect()) == list(range(1000))


def test_written_files(spark, tmp_path):
    """What is written reads back the same: sequences, records, regions, k-mer tables."""
    reads = spark.createDataFrame([("a", "x", "ACGTACG", [1, 2, 3, 4, 5, 6, 7]), ("b", "", "", [])], "ident string, flags string, bases string, quals array<int>")
    S.write_lines(S.fasta_text(reads, 3), str(tmp_path / "fa"), "gzip")
    assert sorted(tuple(x) for x in S.read_fasta(spark, str(tmp_path / "fa")).collect()) == [("a", "", "ACGTACG"), ("b", "", "")]
    S.write_lines(S.fastq_text(reads), str(tmp_path / "fq"))
    assert sorted((x.ident, x.bases, x.quals, x.error) for x in S.read_fastq(spark, str(tmp_path / "fq")).collect()) == [("a", "ACGTACG", [1, 2, 3, 4, 5, 6, 7], 0), ("b", "", [], 0)]
    sam = "x\t16\tc\t7\t60\t1M2D2M\t*\t0\t0\tAAC\tABC\tNM:Z:1\tRG:Z:q\n"
    vcf = "1\t5\t.\tAC\tC,G\t9.5\tPASS\tAF=0.1,0.2;DB\n1\t7\trs1\tA\t.\t.\tq10;s50\t.\n"
    (tmp_path / "sam").write_text(sam)
    (tmp_path / "vcf").write_text("##x\n" + vcf)
    lines = lambda df: "".join(sorted(x.value + "\n" for x in df.collect()))
    assert lines(S.sam_text(S.read_sam(spark, str(tmp_path / "sam")))) == sam
    assert lines(S.vcf_text(S.read_vcf(spark, str(tmp_path / "vcf")))) == vcf
    at = lambda k: sorted((x.chrom, x.bgn, x.end_) for x in S.read_regions(spark, str(tmp_path / k), k).collect())
    assert at("sam") == [("c", 6, 11)] and at("vcf") == [("1", 4, 6), ("1", 6, 7)]
    (tmp_path / "gff").write_text("##gff\nc\ts\tgene\t11\t20\t.\t+\t.\tID=1\n")
    (tmp_path / "bed").write_text("c\t10\t20\n")
    assert at("gff") == at("bed") == [("c", 10, 20)]
    assert lines(S.bed_text(S.read_bed(spark, str(tmp_path / "bed")))) == "c\t10\t20\n"
    table = spark.range(500).selectExpr("translate(lpad(conv(id, 10, 4), 5, '0'), '0123', 'ACTG') as kmer", "id as value")
    kmers.write(table, str(tmp_path / "db"), 4)
    assert sorted(map(tuple, kmers.read(spark, str(tmp_path / "db")).collect())) == sorted(map(tuple, table.collect()))
    assert kmers.read(spark, str(tmp_path / "db"), "AC", "AG").count() == table.filter("kmer between 'AC' and 'AG'").count() > 0


def test_packed_and_changed_files(spark, tmp_path):
    import lzma

    (tmp_path / "a.xz").write_bytes(lzma.compress("".join(f"line {i}\n" for i in range(25_000)).encode()))
    (tmp_path / "b.xz").write_bytes(lzma.compress(b""))
    assert sorted(x.line for x in S.read_xz_lines(spark, str(tmp_path)).collect()) == sorted(f"line {i}" for i in range(25_000))
    saved = spark.createDataFrame(S.file_states(spark, str(tmp_path)).collect())
    assert S.changed(saved, S.file_states(spark, str(tmp_path))).count() == 0
    (tmp_path / "a.xz").write_bytes(b"other")
    (tmp_path / "b.xz").unlink()
    (tmp_path / "c.xz").write_bytes(b"new")
    got = {x.path[-4:]: x.state for x in S.changed(saved, S.file_states(spark, str(tmp_path))).collect()}
    assert got == {"a.xz": "changed", "b.xz": "gone", "c.xz": "new"}


def test_key_values(spark):
    lines = {"a = b": ("a", "b"), "a key:=  b c  # no": ("a key", "b c"), "a=": ("a", ""), "a =#x": ("a", "#x"), "a = #x": ("a", ""), "a": None, "# a = b": None, "=b": None, "a #c = d": None, "": None}
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", text.key_value(F.col("line")).alias("kv"))
    assert {r.line: r.kv and tuple(r.kv) for r in df.collect()} == lines


def test_twister(spark):
    seeds = spark.createDataFrame([(5489,), (None,)], "s long").select("s", random_numbers.twister(F.col("s"), 4).alias("y"))
    rows = seeds.select("s", "y", random_numbers.real_closed(F.col("y")[0]).alias("u"), random_numbers.gaussian(F.col("y")).alias("g")).collect()
    got = {r.s: r for r in rows}
    assert got[5489].y == [3499211612, 581869302, 3890346734, 3586334585] and got[None].y is None and got[None].g is None
    assert got[5489].u == 3499211612 / (2**32 - 1)
    assert spark.range(1).select(random_numbers.twister(F.lit(1), 2).alias("y")).select(F.col("y")[0], random_numbers.wide(F.col("y"), 0)).first()[:] == (1791095845, (1791095845 << 32 | 4282876139) - 2**64 * (1791095845 >> 31))
    many = spark.range(4000).select(random_numbers.twister(F.col("id"), 40).alias("y")).select(random_numbers.gaussian(F.col("y"), 3.0, 2.0).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(many[0] - 3) < 0.15 and abs(many[1] - 2) < 0.15


def test_edit_paths(spark):
    assert alignment.edit_path("ACGT", "ACT", "global") == (1, 0, 3, "2=1I1=", "acGt", "ac-t")
    assert alignment.edit_path("", "AC", "global")[:4] == (2, 0, 2, "2D") and alignment.edit_path("", "AC", "infix")[:4] == (0, 0, 0, "")
    assert alignment.edit_path("ACGT", "TTACGTT", "infix")[:4] == (0, 2, 6, "4=")
    assert alignment.edit_path("ACGT", "AGGTTT", "prefix")[:4] == (1, 0, 4, "1=1X2=")
    row = spark.createDataFrame([("AAC", None), (None, None)], "a string, b string").select(alignment.edit_paths(F.col("a"), F.col("b")).alias("r")).select("r.*", alignment.path_summary(F.col("r.cigar")).alias("s")).collect()
    assert [r.distance for r in row] == [3, 0] and tuple(row[0].s) == (0, 0, 3, 0, 1, 0)


def test_bit_edges(spark):
    row = spark.range(1).select(F.lit(-2).cast("long").alias("x")).select(*[f(F.col("x"), n) for f in (bits.clear_left, bits.keep_left, bits.clear_right, bits.keep_right) for n in (0, 64, 70)], bits.rotate_right(F.col("x"), 0), bits.rotate_right(F.col("x"), 64)).first()
    assert tuple(row) == (-2, 0, 0, 0, -2, -2, -2, 0, 0, 0, -2, -2, -2, -2)
    words = F.array(F.lit(-1).cast("long"))
    assert tuple(spark.range(1).select(bits.get_bit(words, F.lit(64)), bits.set_bit(words, F.lit(64), False)[0]).first()) == (None, -1)


def test_coverage_peaks(spark):
    import math

    curve = [(v, int(1e6 * math.exp(-v) + 4000 * math.exp(-((v - 20) ** 2) / 18) + 9000 * math.exp(-((v - 40) ** 2) / 50))) for v in range(1, 90)]
    hist = spark.createDataFrame([*curve, (5000, 10**9)], "value long, occurrences long")
    got = {r.peak: r for r in kmers.peaks(hist).collect()}
    assert abs(got[1].coverage - 20) < 0.5 and abs(got[2].coverage - 40) < 0.5 and 5 < got[0].coverage < 16
    assert (got[1].ploidy, got[2].ploidy) == (0.5, 1.0) and got[3].coverage == 0
    assert kmers.peaks(hist.limit(0)).count() == 0


def test_streams_in_batches_and_restarts(spark, tmp_path):
    """Three files are three batches; after a restart only new files are counted, and old counts stay."""
    from strandq.streaming import counting

    def put(k):
        spark.createDataFrame([(k, "ACGTACGTTTACG" * (k + 1)), (k + 10, "NNNACGTA")], "seq_idx long, bases string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    def run():
        source = spark.readStream.schema("seq_idx long, bases string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        return {x.kmer: x.value for x in counting.count_stream(spark, source, 5, str(tmp_path / "out"), str(tmp_path / "state")).collect()}

    whole = lambda: {x.kmer: x.value for x in kmers.count(spark.read.parquet(str(tmp_path / "in/*")), 5).collect()}
    for k in range(3):
        put(k)
    assert run() == whole() and len(list((tmp_path / "out").iterdir())) == 3
    put(3)
    assert run() == whole() and len(list((tmp_path / "out").iterdir())) == 4


def test_hot_kmers_are_dealt(spark, monkeypatch):
    """Positions of windows that nearly all sequences have, held against loops; sequences longer than a block."""
    from collections import defaultdict

    from strandq.operators import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    a = [(i, "A" * 12 + "CGT"[i % 3] + "TTG") for i in range(9)] + [(99, None), (98, "ACG"), (97, "aaaannnaaaagt")]
    b = [(i, "G" + "T" * 9 + "CA") for i in range(5)] + [(7, "AAAAGT")]
    schema = "seq_idx long, bases string"
    flip = str.maketrans("ACGT", "TGCA")
    key = lambda w: min(w.translate(str.maketrans("ACTG", "0123")), w.translate(flip)[::-1].translate(str.maketrans("ACTG", "0123")))
    places = defaultdict(list)
    for i, t in b:
        for p in range(len(t) - 4):
            places[key(t[p : p + 5])].append((i, p))
    want = sorted((i, p, *x) for i, t in a for p in range(len(t or "") - 4) if set(t[p : p + 5].upper()) <= set("ACGT") for x in places[key(t[p : p + 5].upper())])
    got = kmers.positions(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 5)
    assert sorted((x.query_idx, x.query_pos, x.seq_idx, x.pos) for x in got.collect()) == want
    monkeypatch.setattr(kmers, "BLOCK", 7)
    text = b"ACGTNACGTTGCAACGTAGGT" * 3
    got = [(int(p), int(f), int(r)) for x in kmers.windows(text, 4) for p, f, r in zip(x[0], *x[1], *x[2], strict=True)]
    digits = {65: 0, 67: 1, 84: 2, 71: 3}
    plain = [(p, sum(digits[c] * 4 ** (3 - j) for j, c in enumerate(text[p : p + 4])), sum((digits[c] ^ 2) * 4**j for j, c in enumerate(text[p : p + 4]))) for p in range(len(text) - 3) if b"N" not in text[p : p + 4]]
    assert got == plain


def test_record_functions(spark):
    df = spark.createDataFrame([(1, "AGCTCCGC", "C+m,1,0;C+h?,0;", [10, 20, 30]), (2, "AAA", "C+m,0;", [5]), (3, "", None, None)], "id long, seq string, mm string, ml array<int>")
    assert sorted(map(tuple, records.modifications(df).collect())) == [(1, "C", "h", 2, 30), (1, "C", "m", 4, 10), (1, "C", "m", 5, 20)]
    assert text.java_pattern("a({c}b.)^[[:alpha:]_]{,3}({p}xy\\.)$") == r"a(b(?s:.))\^[\p{Alpha}_]{0,3}(?:(?:x(?:y(?:\.)?)?)?)\$"
    row = spark.range(1).select(text.longest_match(F.lit("abcab!"), "(a|ab|abc)*"), text.longest_match(F.lit("xyz1"), "({p}xyw)({c}[0-9])?"), text.longest_match(F.lit("q"), "a*"), text.hex_dump(F.lit(b"")), text.range_numbers(F.lit("3-1,2/4,4,9-"))).first()
    assert [list(x) if x is not None else None for x in row] == [["abcab"], ["xy", ""], None, [], [2, 3, 4]]


def test_trimmed_alleles(spark):
    df = spark.createDataFrame([(["C", "G", "T"], [0, 3, 1, None]), ([], [0]), (["C"], [])], "alts array<string>, calls array<int>")
    got = [(r[0], r[1]) for r in df.select(*records.trimmed_alleles(F.col("alts"), F.col("calls"))).collect()]
    assert got == [(["C", "T"], [0, 2, 1, None]), ([], [0]), ([], [])]
