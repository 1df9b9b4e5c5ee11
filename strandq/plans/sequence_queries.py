"""Registered queries of long k-mers, whole pairs, pile-ups with insertions, likelihoods, sets of intervals, streams of codes,
allele arrays, and pieces over batches; importing this module adds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, codes, text
from ..functions import bases as B
from ..operators import alignment, intervals, kmers, pairing, qualities, records, sequences, stats
from ..sources import sequence_files as S
from ..sources.shared import scratch
from ..streaming import carry, counting
from .registry import DB, IV, K, PAGE_READS, READS, RG, ROW, iv, of_length, page_reads, query, reads, rg, rows, spread, table


# ---- k-mers ----
def _long(k):
    def f(spark, d):
        return kmers.count(reads(spark, d), k)

    f.__name__, f.__doc__ = f"kmer10_of_{k}", f"Canonical k-mers of {k} bases with their number, counted as two packed words."
    return query(f"with {of_length(k)} select kmer, count(*) as value from can group by kmer")(f)


kmer10_of_33, kmer10_of_64 = _long(33), _long(64)


@query(f"with {of_length(33)} select q.seq_idx as query_idx, q.pos as query_pos, r.seq_idx, r.pos, q.kmer from can q join can r on q.kmer = r.kmer")
def join05_long_positions(spark, d):
    """Places that share 33 bases, of all reads with all reads."""
    out = kmers.positions(reads(spark, d), reads(spark, d), 33)
    return out.select("query_idx", F.col("query_pos").cast("long").alias("query_pos"), "seq_idx", F.col("pos").cast("long").alias("pos"), "kmer")


LETTERS = "l as (select unnest(['A', 'C', 'T', 'G']) as c), sp as (select a.c || b.c || c.c || d.c || e.c || f.c as kmer from l a, l b, l c, l d, l e, l f)"


@query(f"with {of_length(6)}, db as (select kmer, count(*) as value from can group by kmer), {LETTERS}, t as (select sp.kmer, value, reverse(translate(sp.kmer, 'ACGT', 'TGCA')) as rc from sp left join db on sp.kmer = db.kmer) "
       "select kmer = rc as palindrome, translate(kmer, 'ACTG', '0123') < translate(rc, 'ACTG', '0123') as below, count(*) as n, count(value) as seen, cast(coalesce(sum(value), 0) as bigint) as windows from t group by 1, 2")
def kmer09_census(spark, d):
    """Of all k-mers of six bases, how many are palindromes or below their reverse complement, and how many of these the reads have."""
    m = F.col("kmer")
    seen = kmers.space(spark, 6).join(kmers.count(reads(spark, d), 6), "kmer", "left")
    return seen.groupBy(B.is_palindrome(m).alias("palindrome"), (B.key(m) < B.key(B.complement_reversed(m))).alias("below")).agg(F.count("*").alias("n"), F.count("value").alias("seen"), F.coalesce(F.sum("value"), F.lit(0)).alias("windows"))


@query("with recursive f as (select 0::bigint as n, 1::hugeint as f, 1::hugeint as g union all select n + 1, g, f + g from f where n < 92) select o_orderkey as id, cast(f as varchar) as f from orders join f on n = o_orderkey % 93")
def math01_fibonacci(spark, d):
    """The Fibonacci number of each order; all that fit 64 bits without a sign occur."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), bits.fibonacci(F.col("o_orderkey") % 93).cast("string").alias("f"))


# ---- pairs ----
WHOLE = f"{READS}, {PAGE_READS}, pr as (select r.seq_idx as id, upper(r.bases) as a, upper(p.bases) as b from reads r join page_reads p on r.seq_idx = p.seq_idx)"


@query(f"with {WHOLE} select id, levenshtein(a, b) as distance, levenshtein(a, b) as edits, a, b from pr")
def aln04_whole_reads(spark, d):
    """Paths between whole reads of two tables: as many edits as the distance, and both reads without gaps."""
    pair = reads(spark, d).select(F.col("seq_idx").alias("id"), F.upper("bases").alias("a")).join(page_reads(spark, d).select(F.col("seq_idx").alias("id"), F.upper("bases").alias("b")), "id")
    r = pair.withColumn("r", alignment.edit_paths(F.col("a"), F.col("b"))).withColumn("s", alignment.path_summary(F.col("r.cigar")))
    bare = lambda c: F.upper(F.replace(F.col(c), F.lit("-"), F.lit("")))
    return r.select("id", F.col("r.distance").cast("long").alias("distance"), F.expr("s.mismatches + s.inserted + s.deleted").cast("long").alias("edits"), bare("r.shown_a").alias("a"), bare("r.shown_b").alias("b"))


@query()
def aln11_realigned(spark, d):
    """Qualities of reads with a changed base and a gap, written with it or without, capped by realigning them to the sequences they come from."""
    own = reads(spark, d).select(F.col("seq_idx").alias("chrom"), F.upper("bases").alias("bases"))
    at, cut = F.col("chrom") % 8, lambda c, n: F.col("bases").substr((c + 1).cast("int"), F.lit(n))
    kind = F.col("chrom") % 3
    changed = F.translate(cut(at + 25, 1), "ACGT", "CATG")
    whole = F.concat(cut(at, 25), changed, cut(at + 26, 24))
    lost, more = F.concat(cut(at, 40), cut(at + 42, 10)), F.concat(cut(at, 20), F.lit("AC"), cut(at + 20, 28))
    made = own.select("chrom", at.alias("pos"), F.when(kind == 0, whole).when(kind == 1, lost).otherwise(more).alias("seq"), F.when(kind == 0, "50M").when(F.col("chrom") % 2 == 0, "50M").when(kind == 1, "40M2D10M").otherwise("20M2I28M").alias("cigar"),
                      F.translate(F.substring(F.concat(F.md5(F.col("chrom").cast("string")), F.md5(F.concat(F.lit("q"), "chrom"))), 1, 50), "0123456789abcdef", "ABCDEFGHIJKLMNOP").alias("qual"), F.col("chrom").alias("id"))
    out = qualities.realigned(qualities.with_reference(made, own))
    return out.select("id", "pos", "cigar", "seq", "qual", "capped")


# ---- pile-ups ----
TWICE = f"substr(concat(md5({ROW}), md5(concat('x', {ROW}))), 1, cast(cast(l_quantity as int) + 2 * l_linenumber as int))"
PILED = (f"p0 as (select l_suppkey as chrom, l_partkey % 500 as pos, concat('s', cast(l_orderkey % 3 as varchar(9))) as sample, cast(l_orderkey % 2 as int) as strand, cast(l_quantity as int) as q, cast(l_linenumber as int) as r, cast(l_partkey % 3 + 1 as int) as d, "
         f"translate({TWICE}, '0123456789abcdef', 'ACGTACGTACGTACGT') as seq, translate({TWICE}, '0123456789abcdef', 'ABCDEFGHIJKLMNOP') as qual from lineitem)")
COVERED = (f"{PILED}, m as (select chrom, sample, strand, pos + k as pos, substr(seq, cast(k as int) + 1, 1) as base, ascii(substr(qual, cast(k as int) + 1, 1)) - 33 as quality, case when k = q - 1 then substr(seq, q + 1, r) end as inserted from (select *, unnest(range(0, q)) as k from p0) x "
           "union all select chrom, sample, strand, pos + q + k, '-', ascii(substr(qual, q + r, 1)) - 33, null from (select *, unnest(range(0, d)) as k from p0) x "
           "union all select chrom, sample, strand, pos + q + d + k, substr(seq, cast(q + r + k as int) + 1, 1), ascii(substr(qual, cast(q + r + k as int) + 1, 1)) - 33, null from (select *, unnest(range(0, r)) as k from p0) x)")


def _piled(spark, d):
    return rows(spark, d, "p0", PILED).withColumn("cigar", F.format_string("%dM%dI%dD%dM", "q", "r", "d", "r"))


@query(f"with {COVERED} select sample, chrom, pos, base, inserted, count(*) as n, cast(sum(quality) as bigint) as quality from m group by all")
def agg19_columns(spark, d):
    """The columns of a pile-up by sample: bases and deletions with the bases inserted behind them, their number and qualities."""
    return sequences.pileup(_piled(spark, d), "sample")


GENOTYPES = [(i, j) for i in range(4) for j in range(i, 4)]
_REST = lambda i, j: " + ".join([f"c{k}" for k in range(4) if k not in (i, j)] or ["0"])
_EVEN = lambda i, j: f" - 4.343 * (lgamma(n{i} + n{j} + 1) - lgamma(n{i} + 1) - lgamma(n{j} + 1) - (n{i} + n{j}) * ln(2))" if i != j else ""


@query(f"with {COVERED}, b as (select chrom, pos, instr('ACGT', base) - 1 as b, quality as q, strand, row_number() over () as id from m where base <> '-'), "
       "o as (select *, count(*) over (partition by chrom, pos) as n, row_number() over (partition by chrom, pos, b order by q desc, strand desc, id) - 1 as c, row_number() over (partition by chrom, pos, b, strand order by q desc, id) - 1 as w from b), "
       "qn as (select distinct q, n from o), t as (select q, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(pow(10, -q / 10)) + (n - k) * ln(1 - pow(10, -q / 10))) as p from (select q, n, unnest(range(0, n + 1)) as k from qn) x), "
       "u as (select q, n, k, sum(p) over (partition by q, n order by k desc) as tail from t), v as (select q, n, k, -10 * log10(lag(tail) over (partition by q, n order by k desc) / tail) as beta from u where tail > 0), "
       "s as (select chrom, pos, b, count(*) as n, sum((pow(0.83, w) * 0.97 + 0.03) * beta) as c from o join v on o.q = v.q and o.n = v.n and o.c = v.k group by chrom, pos, b), "
       "g as (select chrom, pos, " + ", ".join(f"coalesce(max(case when b = {k} then n end), 0) as n{k}, coalesce(max(case when b = {k} then c end), 0) as c{k}" for k in range(4)) + " from s group by chrom, pos) "
       "select chrom, pos, cast(n0 + n1 + n2 + n3 as bigint) as depth, " + ", ".join(f"round(greatest(0, {_REST(i, j)}{_EVEN(i, j)}), 4) as {'acgt'[i]}{'acgt'[j]}" for i, j in GENOTYPES) + " from g")
def aln11_likelihoods(spark, d):
    """Likelihoods of the ten genotypes at each position of a pile-up."""
    out = qualities.read_likelihoods(_piled(spark, d))
    return out.select("chrom", "pos", "depth", *(F.round(F.col("likelihoods")[k], 4).alias("acgt"[i] + "acgt"[j]) for k, (i, j) in enumerate(GENOTYPES)))


# ---- statistics ----
RANKED = "e as (select user_id as grp, value as x from events where value is not null), k as (select grp, x, row_number() over (partition by grp order by x) - 1 as r, count(*) over (partition by grp) as n from e), med as (select grp, (min(x) + max(x)) / 2 as median from k where r = n // 2 or r = (n - 1) // 2 group by grp)"


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("value").alias("x"))


@query(f"with {RANKED} select grp, round(median, 9) as median from med")
def agg11_doubles(spark, d):
    return stats.median(_events(spark, d)).select("grp", F.round("median", 9).alias("median"))


@query(f"with {RANKED}, a as (select e.grp, abs(x - median) as x from e join med on e.grp = med.grp), o as (select grp, x, row_number() over (partition by grp order by x) - 1 as r, count(*) over (partition by grp) as n from a) select grp, round(x, 9) as mad from o where r = n // 2")
def agg12_doubles(spark, d):
    return stats.mad(_events(spark, d)).select("grp", F.round("mad", 9).alias("mad"))


# ---- intervals ----
OTHER = "ot as (select l_suppkey as grp, l_orderkey + l_linenumber * 5 as bgn, l_orderkey + l_linenumber * 5 + l_partkey % 20 as end_ from lineitem)"
SPOTS = f"{IV}, {OTHER}, pa as (select distinct grp, unnest(range(bgn, end_)) as pos from iv), pb as (select distinct grp, unnest(range(bgn, end_)) as pos from ot)"
_SPOTS = {"union": "select * from pa union select * from pb", "intersection": "select * from pa intersect select * from pb", "difference": "select * from pa except select * from pb", "either": "(select * from pa except select * from pb) union (select * from pb except select * from pa)"}


def _combined(name):
    def f(spark, d):
        return intervals.combined(iv(spark, d), rows(spark, d, "ot", OTHER), name)

    f.__name__, f.__doc__ = f"int09_{name}", f"The {name} of two lists of intervals, in the fewest intervals."
    return query(f"with {SPOTS}, s as ({_SPOTS[name]}), i as (select grp, pos, pos - row_number() over (partition by grp order by pos) as island from s) select grp, min(pos) as bgn, max(pos) + 1 as end_ from i group by grp, island")(f)


int09_union, int09_intersection, int09_difference, int09_either = map(_combined, _SPOTS)


@query(f"with {SPOTS}, i as (select o.*, unnest(range(bgn, end_)) as pos from (select row_number() over () as id, * from ot) o), n as (select i.id, any_value(i.grp) as grp, any_value(i.bgn) as bgn, any_value(i.end_) as end_, count(*) as k, count(pa.pos) as hit from i left join pa on pa.grp = i.grp and pa.pos = i.pos group by i.id) select grp, bgn, end_ from n where k = hit")
def int09_contained(spark, d):
    """Intervals of which another list covers every position."""
    return intervals.contained(rows(spark, d, "ot", OTHER), iv(spark, d), 64)


CHANGES = f"ch as (select {ROW} as id, l_suppkey as grp, l_orderkey as bgn, substr('ACGT', 1, cast(l_linenumber % 4 + 1 as int)) as ref, substr('ACGTT', 1, cast(l_partkey % 5 + 1 as int)) as a1, case when l_orderkey % 3 = 0 then 'AT' end as a2 from lineitem)"


@query(f"with {CHANGES}, {RG}, f as (select *, least(length(ref), length(a1), case when a2 is null then 9 else 1 end) as off from ch) select id from f where exists (select 1 from rg where rg.grp = f.grp and f.bgn + f.off <= rg.end2 - 1 and f.bgn + length(f.ref) - 1 >= rg.beg2)")
def join09_changes(spark, d):
    """Variants whose change lies in a region, the third definition of touching it."""
    v = rows(spark, d, "ch", CHANGES).withColumn("alts", F.filter(F.array("a1", "a2"), lambda x: x.isNotNull())).withColumn("end_", F.col("bgn") + F.length("ref"))
    return intervals.touching(v, rg(spark, d), 256, by="change").select("id")


# ---- codes ----
@query("select o_orderkey as id, concat_ws(',', o_orderkey + 1, o_custkey % 1048576, o_orderkey % 50, o_custkey + 1, o_orderkey * 7 + 1, o_orderkey + 3) as numbers from orders")
def cod03_streams(spark, d):
    """Numbers as a stream of codes of five kinds, and back."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    kinds = ["gamma", ("fixed", 20), "unary", "zeckendorf", "delta"]
    coded = codes.encoded(F.array(k + 1, c % 1048576, k % 50, c + 1, k * 7 + 1, k + 3), *kinds)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(codes.decoded(coded, *kinds).cast("array<string>"), ",").alias("numbers"))


# ---- variants ----
_VALUES = [f"(l_partkey + {i}) % {11 + i}" for i in range(6)]
_KEPT = {0: [0, 1], 1: [0, 2], 2: [0], 3: [0, 1, 2]}


def _enumerated(kind: str) -> str:
    """SQL of the values of the kept alleles, by writing out which they are."""
    of = {"g": lambda k: [b * (b + 1) // 2 + a for b in k for a in k if a <= b], "r": lambda k: k, "a": lambda k: [x - 1 for x in k if x]}[kind]
    cases = " ".join(f"when {n} then concat_ws(',', " + (", ".join(f"v{i}" for i in of(k)) or "''") + ")" for n, k in _KEPT.items())
    return f"case l_linenumber % 4 {cases} end"


@query(f"with v as (select {ROW} as id, l_linenumber, " + ", ".join(f"cast({x} as varchar) as v{i}" for i, x in enumerate(_VALUES)) + f" from lineitem) select id, {_enumerated('g')} as genotypes, {_enumerated('r')} as alleles, {_enumerated('a')} as alternatives from v")
def var01_arrays(spark, d):
    """Arrays with a value per genotype, allele and alternative allele, for the alleles that stay of three."""
    v = table(spark, d, "lineitem").selectExpr(f"{ROW} as id", "l_linenumber % 4 as n", f"array({', '.join(_VALUES)}) as v")
    kept = F.when(F.col("n") == 0, F.array(*map(F.lit, _KEPT[0]))).when(F.col("n") == 1, F.array(*map(F.lit, _KEPT[1]))).when(F.col("n") == 2, F.array(*map(F.lit, _KEPT[2]))).otherwise(F.array(*map(F.lit, _KEPT[3])))
    of = lambda size, number: F.array_join(records.values_of_kept(F.slice("v", 1, size), kept, F.lit(3), number).cast("array<string>"), ",")
    return v.select("id", of(6, "G").alias("genotypes"), of(3, "R").alias("alleles"), of(2, "A").alias("alternatives"))


CALLED = f"v as (select {ROW} as id, concat(l_returnflag, 'A') as a1, concat(l_linestatus, 'C') as a2, cast(l_linenumber % 4 as int) as c1, cast(l_orderkey % 3 as int) as c2, cast(case when l_partkey % 5 = 0 then null else l_partkey % 2 * 3 end as int) as c3 from lineitem)"


@query(f"with {CALLED}, w as (select id, [a1, a2, 'G'] as alts, [c1, c2, c3] as calls from v) select id, array_to_string(list_transform(list_filter([1, 2, 3], lambda k: list_contains(calls, k)), lambda k: alts[k]), ',') as alts, "
       "array_to_string(list_transform(calls, lambda c: case when c is null then '.' else cast(len(list_filter(list_distinct(calls), lambda u: u > 0 and u <= c)) as varchar) end), ',') as calls from w")
def var01_trimmed_calls(spark, d):
    """The alleles of three that some call uses, and the calls renumbered."""
    v = rows(spark, d, "v", CALLED)
    kept, new = records.trimmed_alleles(F.array("a1", "a2", F.lit("G")), F.array("c1", "c2", "c3"))
    return v.select("id", F.array_join(kept, ",").alias("alts"), F.array_join(new.cast("array<string>"), ",", ".").alias("calls"))


@query("select p_partkey, nullif(regexp_extract(translate(md5(p_name), '0123456789abcdef', 'aaaabaaaabaaaaab'), '^(ab?)+'), '') as longest from part")
def regx04_longest_names(spark, d):
    """The longest beginning of each text that repeats of three alternatives make, whichever is named first."""
    t = F.translate(F.md5("p_name"), "0123456789abcdef", "aaaabaaaabaaaaab")
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", text.longest_match(t, "(a|ab|abab)*")[0].alias("longest"))


@query()
def join08_sets(spark, d):
    """Variants of three sources, paired where alleles overlap or both are of one base."""
    alts = "filter(array(case when l_orderkey % 2 = 0 then 'C' when l_orderkey % 3 = 0 then 'AC' else 'G' end, case when l_orderkey % 5 = 0 then 'T' when l_orderkey % 7 = 0 then 'ACC' end), x -> x is not null)"
    v = table(spark, d, "lineitem").selectExpr("l_suppkey as chrom", "l_partkey % 500 as pos", "'A' as ref", f"{alts} as alts", "l_linenumber % 3 as s")
    out = pairing.paired([v.filter(f"s = {k}") for k in range(3)], "snps")
    shown = F.array_join(F.transform("records", lambda x: F.concat_ws(":", x["source"].cast("string"), F.array_join(x["alts"], "/"))), ",")
    return out.select("chrom", "pos", "nth", F.array_join("sources", ",").alias("sources"), shown.alias("records"))


# ---- streams ----
def _pieces(spark, d):
    """The reads as a stream of pieces of 20 bases, the last ones first, in batches of as many files as two thirds of the tasks that write them."""
    at, files = scratch(spark), max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = sequences.chunked(reads(spark, d), 20).select("seq_idx", "chunk", "piece", "is_last")
    cut.withColumn("turn", -F.col("chunk")).repartitionByRange(files, "turn", "seq_idx").drop("turn").write.parquet(at)
    return spark.readStream.schema("seq_idx long, chunk int, piece string, is_last boolean").option("maxFilesPerTrigger", -(-2 * files // 3)).parquet(at)


@query(f"with {DB} select kmer, value from db")
def stm03_chunks(spark, d):
    """Counts of k-mers of reads that come in pieces, batch after batch and out of order."""
    at = scratch(spark)
    return counting.count_chunks(spark, _pieces(spark, d), K, f"{at}/out", f"{at}/state").select("kmer", "value")


@query(f"with {READS}, p as (select seq_idx, bases, unnest(range(1, length(bases) + 1)) as i from reads), c as (select seq_idx, i, substr(bases, cast(i as int), 1) as b, case when i > 1 then substr(bases, cast(i as int) - 1, 1) else '' end as before from p) select seq_idx, string_agg(b, '' order by i) as squeezed from c where upper(b) <> upper(before) group by seq_idx")
def stm03_squeezed(spark, d):
    """Reads that come in pieces, with runs squeezed."""
    at = scratch(spark)
    carry.squeezed(_pieces(spark, d)).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("seq_idx long, chunk long, piece string").parquet(f"{at}/out")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "")
    return parts.groupBy("seq_idx").agg(joined.alias("squeezed"))


@query(f"with {DB} select kmer, value from db")
def stm02_arriving_files(spark, d):
    """Counts of k-mers of FASTA files that arrive in a folder, one a batch."""
    at = scratch(spark)
    S.write_lines(S.fasta_text(reads(spark, d).select(F.col("seq_idx").cast("string").alias("ident"), "bases"), 30).repartition(3), f"{at}/in")
    return counting.count_stream(spark, S.read_fasta(spark, f"{at}/in", stream=True, files=1), K, f"{at}/out", f"{at}/state").select("kmer", "value")


# ---- modified bases ----
@query(f"with {READS}, p as (select seq_idx as id, list_filter(range(0, length(bases)), lambda i: upper(substr(bases, cast(i as int) + 1, 1)) = 'C') as own from reads), "
       "g as (select id, own, unnest([0, 1, 2]) as k from p) select id, 'C' as base, case k when 2 then 'h' else 'm' end as code, cast(own[case k when 0 then id % 3 + 1 when 1 then id % 3 + 3 else 2 end] as int) as pos, cast(case k when 0 then id % 100 else k * 10 + 10 end as int) as quality from g where own[case k when 0 then id % 3 + 1 when 1 then id % 3 + 3 else 2 end] is not null")
def cig04_modified_reads(spark, d):
    """Two modified C and one of another kind in each read, by the numbers of C passed over."""
    i = F.col("seq_idx")
    t = reads(spark, d).select(i.alias("id"), F.col("bases").alias("seq"), F.concat(F.lit("C+m,"), i % 3, F.lit(",1;C+h,1;")).alias("mm"), F.array((i % 100).cast("int"), F.lit(20), F.lit(30)).alias("ml"))
    return records.modifications(t)
