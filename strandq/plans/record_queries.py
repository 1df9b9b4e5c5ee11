"""Registered queries of record filters, variants, headers, mates and files; importing this module adds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases as B
from ..functions import special, text
from ..operators import headers, intervals, kmers, records, stats
from ..sources import sequence_files as S
from ..sources.shared import scratch
from .registry import READS, ROW, of_length, query, reads, rows, spread, table

# Alignment records made of lineitem.
CIGAR = "concat(cast(l_linenumber as varchar(9)), 'S', cast(cast(l_quantity as int) as varchar(9)), 'M', cast(l_linenumber as varchar(9)), 'I', cast(l_partkey % 3 + 1 as varchar(9)), 'D', cast(cast(l_quantity as int) % 5 + 1 as varchar(9)), 'X')"
SAM = (f"sam as (select {ROW} as qname, cast(l_orderkey % 4096 as int) as flag, concat('chr', cast(l_suppkey % 20 as varchar(9))) as rname, l_partkey as pos, cast(l_linenumber * 10 as int) as mapq, {CIGAR} as cigar, "
       "case when l_suppkey % 2 = 0 then '=' else 'chrX' end as rnext, l_partkey + 100 as pnext, l_partkey % 300 as tlen, l_returnflag as qual, cast(l_linenumber as varchar(9)) as nm, concat('lib', cast(l_suppkey % 3 as varchar(9))) as lb, l_linenumber as ln, cast(l_quantity as int) as q, l_partkey % 3 + 1 as dl from lineitem)")


def sam(spark, d):
    return records.variables(rows(spark, d, "sam", SAM).withColumn("tags", F.create_map(F.lit("NM"), "nm", F.lit("LB"), "lb")))


@query(f"with {SAM} select qname, 5 as ncigar, ln + q + ln + q % 5 + 1 as qlen, q + dl + q % 5 + 1 as rlen, cast(ln as bigint) as sclen, pos + q + dl + q % 5 as endpos, pnext as mpos, case when rnext = '=' then rname else rnext end as mrname, lb as library, "
       "flag & 1 <> 0 as flag_paired, flag & 4 <> 0 as flag_unmap, flag & 16 <> 0 as flag_reverse, flag & 2048 <> 0 as flag_supplementary from sam")
def expr09_variables(spark, d):
    return sam(spark, d).select("qname", "ncigar", "qlen", "rlen", "sclen", "endpos", "mpos", "mrname", "library", "flag_paired", "flag_unmap", "flag_reverse", "flag_supplementary")


@query(f"with {SAM} select qname, pos, mapq from sam where mapq >= 30 and flag & 1 <> 0 and not flag & 4 <> 0 and ((pos + q + dl + q % 5) % 7 = 3 or regexp_matches(cigar, '[0-9]+I2D')) and cast(nm as int) < 6 and not lb = 'lib1'")
def pred07_filter(spark, d):
    """A record filter as an expression of Spark SQL over the variables."""
    kept = sam(spark, d).filter("mapq >= 30 and flag_paired and not flag_unmap and (endpos % 7 = 3 or cigar rlike '[0-9]+I2D') and cast(tags['NM'] as int) < 6 and not library = 'lib1'")
    return kept.select("qname", "pos", "mapq")


#: Expressions over records, in Spark's SQL and as the oracle writes them: literals with escapes, operators by their rank, undefined values, patterns, functions.
EXPRESSIONS = {
    "quoted": ("concat('a\\'b\\\\', \"q\")", "concat('a''b\\', 'q')"),
    "numbers": ("1.5e3D + pos", "1.5e3::double + pos"),
    "signs": ("- pos + (+ mapq)", "- pos + (+ mapq)"),
    "flipped": ("~ flag", "~ flag"),
    "negated": ("not (mapq > 20)", "not (mapq > 20)"),
    "ranked": ("pos * 3 % 7 - mapq / 4", "pos * 3 % 7 - mapq / 4"),
    "bits": ("(flag & 12) | (flag ^ 5)", "(flag & 12) | xor(flag, 5)"),
    "compared": ("pos >= 100 and mapq < 50 or flag = 3", "pos >= 100 and mapq < 50 or flag = 3"),
    "equal": ("rnext = '=' and rname <> 'chr1'", "rnext = '=' and rname <> 'chr1'"),
    "pattern": ("cigar rlike '^[0-9]+S[12]' and not cigar rlike '3D'", "regexp_matches(cigar, '^[0-9]+S[12]') and not regexp_matches(cigar, '3D')"),
    "unknown": ("nullif(mapq, 10) > 20 or pos > 100", "nullif(mapq, 10) > 20 or pos > 100"),
    "both": ("nullif(mapq, 10) > 20 and pos > 100", "nullif(mapq, 10) > 20 and pos > 100"),
    "grown": ("round(exp(mapq / 100) + ln(pos + 1) + power(mapq, 2) + sqrt(pos), 6)", "round(exp(mapq / 100) + ln(pos + 1) + power(mapq, 2) + sqrt(pos), 6)"),
    "there": ("tags['NM'] is not null and tags['XX'] is null", "true"),
    "other": ("coalesce(nullif(mapq, 10), -1)", "coalesce(nullif(mapq, 10), -1)"),
    "long": ("length(cigar)", "cast(length(cigar) as int)"),
}


def _expressions(*names):
    sql = ", ".join(f"{EXPRESSIONS[n][1]} as {n}" for n in names)

    def put(f):
        def run(spark, d):
            return sam(spark, d).selectExpr("qname", *(f"{EXPRESSIONS[n][0]} as {n}" for n in names))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(f"with {SAM} select qname, {sql} from sam")(run)

    return put


@_expressions("quoted", "numbers")
def expr01_literals():
    """Texts with escapes and numbers."""


@_expressions("signs", "flipped", "negated")
def expr02_unary():
    """Signs, bits turned, and negation."""


@_expressions("ranked")
def expr03_arithmetic():
    """Products before sums."""


@_expressions("bits")
def expr04_bits():
    """And, or, exclusive or."""


@_expressions("compared")
def expr05_comparisons():
    """Comparisons between both."""


@_expressions("equal", "pattern")
def expr06_equality_and_patterns():
    """Equal, unequal, matching and not matching."""


@_expressions("unknown", "both")
def expr07_undefined():
    """Undefined values under and and or."""


@_expressions("grown", "there", "other", "long")
def expr08_functions():
    """Functions of numbers, texts and undefined values."""


@query("select o_orderkey as id, case when o_orderkey % 5 = 0 then null else 1.0 / (o_orderkey % 5) end as fine, round(list_avg([ascii(x) for x in string_split(o_orderpriority, '')]), 6) as mean, list_min([ascii(x) for x in string_split(o_orderpriority, '')]) as least, list_max([ascii(x) for x in string_split(o_orderpriority, '')]) as most from orders")
def expr08_bytes(spark, d):
    """The mean, least and greatest byte of a text; NaN as an undefined value."""
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    nan = F.when(k == 0, F.lit(float("nan"))).otherwise(1.0 / k)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), records.defined(nan).alias("fine"), F.round(records.byte_mean(p), 6).alias("mean"), F.array_min(records.byte_values(p)).alias("least"), F.array_max(records.byte_values(p)).alias("most"))


FILTERS = "case o_orderkey % 4 when 0 then 'PASS' when 1 then 'q10' when 2 then 'q10;s50' else '.' end"


@query(f"with f as (select o_orderkey as id, {FILTERS} as f from orders) select id, f, f in ('PASS', '.') as passed, f like 'q10%' as low, case when f in ('PASS', '.') then 's50' when f = 'q10' then 'q10;s50' else f end as added, 'PASS' as reset, case f when 'q10' then 'PASS' when 'q10;s50' then 's50' else f end as removed from f")
def pred08_filters(spark, d):
    f = F.split("f", ";")
    shown = lambda c: F.array_join(c, ";")
    rows_ = table(spark, d, "orders").selectExpr("o_orderkey as id", f"{FILTERS} as f")
    return rows_.select("id", "f", records.has_filter(f, "PASS").alias("passed"), records.has_filter(f, "q10").alias("low"), shown(records.add_filter(f, "s50")).alias("added"), shown(records.add_filter(f, "PASS")).alias("reset"), shown(records.remove_filter(f, "q10")).alias("removed"))


@query("select o_orderkey as id, cast(o_orderkey % 100 as varchar) as dp, case when o_orderkey % 3 = 0 then null else '0.5,0.25' end as af, cast(o_custkey as varchar) as new, case when o_orderkey % 3 = 0 then 2 else 3 end as n from orders")
def map01_info(spark, d):
    text_ = lambda c: F.array(c.cast("string"))
    info = F.create_map(F.lit("DP"), text_(F.col("o_orderkey") % 100), F.lit("AF"), F.array(F.lit("1")))
    info = records.info_set(info, "AF", F.when(F.col("o_orderkey") % 3 != 0, F.array(F.lit("0.5"), F.lit("0.25"))))
    rows_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), records.info_set(info, "XX", text_(F.col("o_custkey"))).alias("i"))
    at = lambda k: F.array_join(F.try_element_at("i", F.lit(k)), ",")
    return rows_.select("id", at("DP").alias("dp"), at("AF").alias("af"), at("XX").alias("new"), F.size("i").alias("n"))


HEADERS = "h as (select 1 as source, cast(n_nationkey as int) as old, n_name as name from nation where n_nationkey < 15 union all select 2, cast(24 - n_nationkey as int), n_name from nation where n_nationkey >= 5 union all select 3, cast(r_regionkey as int), r_name from region)"


@query(f"with {HEADERS}, f as (select name, min(source * 1000 + old) as first from h group by name), i as (select name, cast(row_number() over (order by first, name) - 1 as int) as id from f) select h.name, i.id, h.source, h.old from h join i on h.name = i.name")
def join10_headers(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    parts = [n.filter("n_nationkey < 15").selectExpr("1 as source", "cast(n_nationkey as int) as old", "n_name as name"), n.filter("n_nationkey >= 5").selectExpr("2", "cast(24 - n_nationkey as int)", "n_name"), r.selectExpr("3", "cast(r_regionkey as int)", "r_name")]
    return records.header_ids(parts[0].union(parts[1]).union(parts[2]))


MATES = "m as (select l_orderkey as qname, l_partkey % 10 as pos, cast(l_linenumber % 2 + 1 as int) as mate, min(case when l_suppkey % 3 = 0 then 'A' else 'C' end) as base, max(cast(l_quantity as int) * 3) as qual from lineitem group by 1, 2, 3)"


@query(f"with {MATES}, p as (select a.*, b.base as other, b.qual as theirs from m a left join m b on a.qname = b.qname and a.pos = b.pos and a.mate <> b.mate) select qname, pos, mate, base, cast(case when other is null then qual "
       "when other = base then case when mate = 1 then least(qual + theirs, 200) else 0 end when qual > theirs or (qual = theirs and mate = 1) then floor(qual * 4 / 5.0) else 0 end as int) as qual from p")
def join11_mates(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qname"), (F.col("l_partkey") % 10).alias("pos"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("mate")).agg(F.min(F.when(F.col("l_suppkey") % 3 == 0, "A").otherwise("C")).alias("base"), F.max(F.col("l_quantity").cast("int") * 3).alias("qual"))
    return records.mates_settled(m.withColumn("chrom", F.lit("c"))).select("qname", "pos", "mate", "base", "qual")


CALLS = "c as (select cast(l_suppkey as varchar(20)) as chrom, l_partkey as pos, concat('s', cast(l_linenumber as varchar(9))) as sample, concat(cast(l_orderkey % 3 as varchar(9)), case when l_orderkey % 11 = 0 then '' when l_orderkey % 2 = 0 then '/.' when l_orderkey % 5 = 0 then '|0' else '/1' end) as gt from lineitem)"


@query(f"with {CALLS}, k as (select * from c where sample in (select 's' || cast(r_regionkey as varchar) from region)), a as (select chrom, pos, unnest(string_split_regex(gt, '[/|]')) as allele from k) select chrom, pos, count(*) as an, count(*) filter (where allele = '1') as n_one from a where allele <> '.' group by chrom, pos")
def var02_samples(spark, d):
    """Allele counts of a subset of samples."""
    some = table(spark, d, "region").selectExpr("concat('s', r_regionkey) as sample")
    return records.allele_counts(records.sample_subset(rows(spark, d, "c", CALLS), some)).select("chrom", "pos", "an", F.coalesce(F.col("ac")["1"], F.lit(0)).alias("n_one"))


@query(f"with {CALLS} select chrom, pos, sample, gt, case when gt like '%.%' then 'missing' when not gt like '%/%' and not gt like '%|%' then 'hap' when substr(gt, 1, 1) <> substr(gt, 3, 1) then 'het' when substr(gt, 1, 1) = '0' then 'hom_ref' else 'hom_alt' end as kind from c")
def var01_genotypes(spark, d):
    return rows(spark, d, "c", CALLS).withColumn("kind", records.genotype_class(F.col("gt")))


VARIANTS = "v as (select concat('chr', cast(o_custkey % 7 as varchar(9))) as chrom, o_orderkey as pos, substr('ACGTAC', cast(o_orderkey % 4 as int) + 1, cast(o_custkey % 2 + 1 as int)) as ref, substr('GTTACA', cast(o_custkey % 4 as int) + 1, 1) as alt from orders)"


@query(f"with {VARIANTS} select *, row_number() over (order by chrom desc, pos desc, ref desc, alt desc) - 1 as seq_idx from v")
def sort02_sweep(spark, d):
    """A backward sweep over all variants, each with its place in it."""
    return S.numbered(records.in_order(rows(spark, d, "v", VARIANTS), backward=True))


@query("select l_suppkey as chrom, l_partkey % 50 as pos, case when l_linenumber % 2 = 0 then 'snp' else 'indel' end as key, array_to_string(list_sort(list(distinct l_linenumber % 3 + 1)), ',') as sources, count(distinct l_linenumber % 3) as n from lineitem group by 1, 2, 3")
def join08_pairing(spark, d):
    """Variants of three sources merged by position and kind."""
    v = table(spark, d, "lineitem").selectExpr("l_suppkey as chrom", "l_partkey % 50 as pos", "'A' as ref", "case when l_linenumber % 2 = 0 then 'C' else 'AC' end as alt", "l_linenumber % 3 as s")
    out = records.paired_by([v.filter(f"s = {k}") for k in range(3)], "kind")
    return out.select("chrom", "pos", "key", F.array_join("sources", ",").alias("sources"), F.size("alleles").cast("long").alias("n"))


@query("with p as (select doc_id as id, 'ACGTTGCACC' as seq from documents) select id, 'C' as base, case k when 0 then 'm' when 1 then 'm' else 'h' end as code, [1, 8, 6][k + 1] as pos, cast([doc_id_q, 20, 30][k + 1] as int) as quality from (select id, id % 100 as doc_id_q, unnest([0, 1, 2]) as k from p) t")
def cig04_modifications(spark, d):
    """Two modified C and one of another kind, by the numbers of C passed over."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("ACGTTGCACC").alias("seq"), F.lit("C+m,0,1;C+h,1;").alias("mm"), F.array((F.col("doc_id") % 100).cast("int"), F.lit(20), F.lit(30)).alias("ml"))
    return records.modifications(t)


# ---- texts ----
@query("with u as (select page_id, url, range(0, strlen(url), 16) as starts from pages) select page_id, array_to_string(list_transform(starts, lambda s: lpad(lower(to_hex(s)), 8, '0') || '  ' || array_to_string([lower(hex(substr(url, cast(s as int) + i, 1))) for i in range(1, 17) if s + i <= strlen(url)], ' ') || '  ' || substr(url, cast(s as int) + 1, 16)) , chr(10)) as lines from u")
def hash03_hex_dump(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(text.hex_dump(F.encode("url", "UTF-8")), "\n").alias("lines"))


@query(f"with {READS} select seq_idx, translate(upper(bases), 'ACTGN', '01234') as digits, upper(bases) as back from reads")
def seq06_digits(spark, d):
    return reads(spark, d).select("seq_idx", B.digits(F.col("bases")).alias("digits"), B.letters(B.digits(F.col("bases"))).alias("back"))


@query("select c_custkey, regexp_extract(c_name, '^([A-Z][a-z]+)#0*[0-9]*', 1) as word, regexp_extract(c_name, '^[A-Z][a-z]+#(0{0,3})', 0) as whole, regexp_extract(c_name, '^[A-Z][a-z]+#(0{0,3})', 1) as zeros, cast(null as varchar) as caret from customer")
def regx03_dialect(spark, d):
    """Groups that capture only if they say so, prefix groups, and a caret that stands for itself."""
    name = F.col("c_name")
    first, second = text.longest_match(name, "({c}[A-Z]([a-z])+)#0*[[:digit:]]*"), text.longest_match(name, "[A-Z][a-z]+#({c}({p}000))")
    return spread(table(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", first[1].alias("word"), second[0].alias("whole"), second[1].alias("zeros"), text.longest_match(name, "^C")[0].alias("caret"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'ab' when s_suppkey % 3 = 1 then 'abab' else null end as longest from supplier")
def regx04_longest(spark, d):
    """The longest beginning wins, whichever alternative is named first, and an empty one doesn't count."""
    k = F.col("s_suppkey") % 3
    s = F.when(k == 0, "abx").when(k == 1, "ababy").otherwise("xab")
    return table(spark, d, "supplier").select("s_suppkey", text.longest_match(s, "(a|ab|abab)*")[0].alias("longest"))


@query("select event_id, json_extract_string(props, '$.k') as k, cast(json_extract_string(props, '$.k') as bigint) * 2 as twice, json_keys(props)[1] as first_key from events")
def str16_json(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.alias("k"), (k.cast("long") * 2).alias("twice"), F.json_object_keys("props")[0].alias("first_key"))


@query("select page_id, regexp_replace('a/' || url || '/b', '//+', '/', 'g') as path from pages")
def str15_paths_built(spark, d):
    return table(spark, d, "pages").select("page_id", text.joined_path(F.lit("a/"), F.col("url"), F.lit(None).cast("string"), F.lit(""), F.lit("/b")).alias("path"))


# ---- what files hold after writing and reading ----
def _written(spark, lines, compression="none"):
    at = scratch(spark)
    S.write_lines(lines, at, compression)
    return at


@query(f"with {READS} select concat('r', cast(seq_idx as varchar)) as ident, 'a > b' as flags, bases from reads")
def src03_fasta(spark, d):
    """Sequences written as wrapped, compressed FASTA and read back; headers with a mark in them."""
    r = reads(spark, d).select(F.concat(F.lit("r"), "seq_idx", F.lit(" a > b")).alias("ident"), "bases")
    return S.read_fasta(spark, _written(spark, S.fasta_text(r, 20), "gzip"))


@query(f"with {READS} select concat('r', cast(seq_idx as varchar)) as ident, bases, cast(length(bases) * (seq_idx % 40) as bigint) as quality, 0 as error from reads")
def src04_fastq(spark, d):
    r = reads(spark, d).select(F.concat(F.lit("r"), "seq_idx").alias("ident"), "bases", F.array_repeat((F.col("seq_idx") % 40).cast("int"), F.length("bases")).alias("quals"))
    got = S.read_fastq(spark, _written(spark, S.fastq_text(r)))
    return got.select("ident", "bases", F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q).alias("quality"), "error")


@query(f"with {READS} select concat('r', cast(seq_idx as varchar)) as ident, case when seq_idx % 3 = 2 then '' else bases end as bases, case seq_idx % 3 when 2 then 1 else 0 end as error from reads")
def src05_mixed(spark, d):
    """FASTA and FASTQ records side by side, a third of them without their + line."""
    k, ident = F.col("seq_idx") % 3, F.concat(F.lit("r"), "seq_idx")
    lines = F.when(k == 0, F.concat(F.lit(">"), ident, F.lit("\n"), "bases")).when(k == 1, F.concat(F.lit("@"), ident, F.lit("\n"), "bases", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("bases")))).otherwise(F.concat(F.lit("@"), ident, F.lit("\n"), "bases"))
    return S.read_mixed(spark, _written(spark, reads(spark, d).select(lines.alias("value")))).select("ident", "bases", "error")


@query(f"with {READS} select row_number() over (order by seq_idx) - 1 as seq_idx, concat('r', cast(seq_idx as varchar)) as ident, cast(length(bases) as int) as length from reads")
def src10_numbered(spark, d):
    """Sequences numbered in their order, with their lengths."""
    r = reads(spark, d).orderBy("seq_idx").select(F.concat(F.lit("r"), "seq_idx").alias("ident"), F.length("bases").alias("length"))
    return S.numbered(r).select("seq_idx", "ident", "length")


@query(f"with {READS} select concat('r', cast(seq_idx as varchar), ':', cast(seq_idx % 70 + 1 as varchar), '-', cast(seq_idx % 90 + 5 as varchar)) as region, case when seq_idx % 90 + 5 <= seq_idx % 70 then '' else substr(bases, cast(seq_idx % 70 + 1 as int), cast(seq_idx % 90 + 5 - seq_idx % 70 as int)) end as bases from reads")
def src22_fetch(spark, d):
    """A region of each sequence, fetched from pieces of 16 bases; ends beyond the sequence are clipped."""
    r = reads(spark, d).select(F.concat(F.lit("r"), "seq_idx").alias("ident"), "bases", "seq_idx")
    regions = r.select(F.concat("ident", F.lit(":"), F.col("seq_idx") % 70 + 1, F.lit("-"), F.col("seq_idx") % 90 + 5).alias("region"))
    return S.fetch(S.sequence_table(r, 16), regions, 16)


@query(f"with {SAM} select qname, flag, rname, pos, mapq, cigar, nm, lb, pos + q + dl + q % 5 as endpos from sam")
def src20_sam(spark, d):
    """Alignment records written as text and read back, with their ends."""
    full = sam(spark, d).withColumn("seq", F.lit("*"))
    got = records.variables(S.read_sam(spark, _written(spark, S.sam_text(full))))
    return got.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.col("tags")["NM"].alias("nm"), F.col("tags")["LB"].alias("lb"), "endpos")


@query(f"with {SAM} select qname, cast(nm as bigint) + 1 as nm, true as gone, ln + 0.5 as first, cast(-q as double) as last, 'iBf' as kinds from sam")
def src20_sam_tags(spark, d):
    """Tags of all types written and read back, one of them counted up and one taken out."""
    full = rows(spark, d, "sam", SAM).withColumn("seq", F.lit("*"))
    tags = F.create_map(F.lit("NM"), "nm", F.lit("LB"), "lb", F.lit("XF"), (F.col("ln") + 0.5).cast("string"), F.lit("XB"), F.concat(F.lit("s,1,"), (-F.col("q")).cast("string")))
    kinds = F.create_map(*(F.lit(x) for x in ("NM", "i", "XF", "f", "XB", "B")))
    got = S.read_sam(spark, _written(spark, S.sam_text(full.withColumns({"tags": tags, "kinds": kinds}))))
    tags = records.tag_set(records.tag_set(F.col("tags"), "NM", F.col("tags")["NM"].cast("long") + 1), "LB", F.lit(None).cast("string"))
    again = S.read_sam(spark, _written(spark, S.sam_text(got.withColumn("tags", tags))))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: e["value"]), "")
    return again.select("qname", F.col("tags")["NM"].cast("long").alias("nm"), F.col("tags")["LB"].isNull().alias("gone"), records.tag_numbers(F.col("tags")["XF"])[0].alias("first"), records.tag_numbers(F.col("tags")["XB"])[1].alias("last"), kinds.alias("kinds"))


#: A header of lines per size modulo five: names with numbers and types, and lines of a value alone.
HEADERS = r"""h as (select p_size % 5 as source, p_partkey as nth, concat(replace(p_brand, '#', '_'), '.', substr(p_name, 1, 3)) as id, cast(p_size % 3 as varchar(9)) as number, case when p_retailprice > 1000 then 'Integer' else 'Float' end as type, concat(p_name, ', "', p_type, '"') as about from part)"""
HEADER_LINES = r"""concat('##INFO=<ID=', id, ',Number=', number, ',Type=', type, ',Description="', replace(about, '"', '"'), '">')"""


@query(f"with {HEADERS}, m as (select id, arg_min(h, source * 1000000000::bigint + nth) as x, count(distinct concat(number, type)) > 1 as differs from h group by id) "
       r"""select x.source as source, x.nth as nth, 'INFO' as kind, differs, concat('##INFO=<ID=', id, ',Number=', case when differs then '.' else x.number end, ',Description="', replace(x.about, '"', '\"'), '",Version=2>') as line from m """
       "union all select source, nth, 'made', false, concat('##made=', about) from h where source = (select min(source) from h)")
def var02_headers(spark, d):
    """Five headers made one: the first line of each name stays, with another number where they differ, without its type, and
    with a version; of lines of a value alone, those of the first header."""
    h = spread(rows(spark, d, "h", HEADERS))
    about = F.concat(F.lit(',Description="'), F.regexp_replace("about", '"', r'\\"'), F.lit('">'))
    line = F.concat(F.lit("##INFO=<ID="), "id", F.lit(",Number="), "number", F.lit(",Type="), "type", about)
    lines = h.select("source", "nth", F.explode(F.array(line, F.concat(F.lit("##made="), "about"))).alias("line"))
    out = headers.merged(headers.parsed(lines))
    number = F.when(F.col("differs"), ".").otherwise(headers.field(F.col("fields"), "Number"))
    edited = headers.with_field(headers.with_field(headers.with_field(F.col("fields"), "Number", number), "Type", F.lit(None).cast("string")), "Version", F.lit(2))
    return out.withColumn("fields", F.when(F.col("fields").isNotNull(), edited)).select("source", "nth", "kind", "differs", headers.written().alias("line"))


@query(f"with {VARIANTS} select chrom, pos, ref, alt, cast(pos % 50 as double) + 0.5 as qual, 'PASS' as filters, cast(pos % 9 as varchar) as dp from v")
def src20_vcf(spark, d):
    v = rows(spark, d, "v", VARIANTS)
    info = F.create_map(F.lit("DP"), F.array((F.col("pos") % 9).cast("string")), F.lit("DB"), F.array().cast("array<string>"))
    full = v.select("chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alt"), (F.col("pos") % 50 + 0.5).cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), info.alias("info"))
    got = S.read_vcf(spark, _written(spark, S.vcf_text(full)))
    return got.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual", F.array_join("filters", ";").alias("filters"), F.array_join(F.col("info")["DP"], ",").alias("dp"))


@query(f"with {VARIANTS}, s as (select *, unnest(['s0', 's1', 's2']) as sample from v) select chrom, pos, ref, alt, sample, case sample when 's0' then '0/1' when 's1' then '1|1' else '.' end as gt, case sample when 's0' then cast(pos % 9 as varchar) end as dp from s")
def src20_vcf_calls(spark, d):
    """Variants with a FORMAT and three samples, written and read."""
    v = rows(spark, d, "v", VARIANTS)
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), F.concat(F.lit("0/1:"), F.col("pos") % 9), F.lit("1|1"), F.lit("."))
    got = S.read_vcf_calls(spark, _written(spark, v.select(line.alias("value"))), ["s0", "s1", "s2"])
    return got.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "sample", F.col("call")["GT"].alias("gt"), F.col("call")["DP"].alias("dp"))


@query(f"with {READS} select cast(seq_idx as varchar) as ident, bases, 65 as n_quals, 'fastq' as kind from reads union all select cast(seq_idx as varchar), bases, 0, 'fasta' from reads")
def src01_opened(spark, d):
    """Reads from files of two kinds, each opened by what its first lines say."""
    r = reads(spark, d).select(F.col("seq_idx").cast("string").alias("ident"), "bases")
    out = []
    for lines in (S.fastq_text(r, 20), S.fasta_text(r)):
        at = _written(spark, lines)
        out.append(S.open_sequences(spark, at).select("ident", "bases", F.size("quals").alias("n_quals"), F.lit(S.sniff(spark, at)).alias("kind")))
    return out[0].unionByName(out[1])


@query(f"with {READS} select cast(seq_idx as varchar) as ident, case when seq_idx % 2 = 1 then reverse(translate(bases, 'ACGTacgt', 'TGCAtgca')) else bases end as bases, case when seq_idx % 2 = 1 then reverse(repeat('I', 64) || '5') else repeat('I', 64) || '5' end as qual from reads where seq_idx % 3 <> 0")
def src09_sam_reads(spark, d):
    """Alignment records as reads: secondary and supplementary ones left out, those of the reverse strand turned back."""
    i = F.col("seq_idx")
    flag = F.when(i % 3 == 0, F.when(i % 2 == 0, 256).otherwise(2048)).otherwise(0) + i % 2 * 16
    line = F.concat_ws("\t", i, flag, F.lit("c"), i + 1, F.lit(60), F.lit("65M"), F.lit("*"), F.lit(0), F.lit(0), "bases", F.lit("I" * 64 + "5"))
    return S.sam_reads(S.read_sam(spark, _written(spark, reads(spark, d).select(line.alias("value")))))


@query("select concat('c', cast(s_suppkey % 7 as varchar)) as chrom, s_suppkey * 10 as bgn, s_suppkey * 10 + 25 as end_, 3 as n_fields from supplier")
def src23_regions(spark, d):
    """A table of regions by its kind's columns."""
    r = table(spark, d, "supplier").selectExpr("concat('c', s_suppkey % 7) as chrom", "s_suppkey * 10 as bgn", "s_suppkey * 10 + 25 as end_")
    return S.read_regions(spark, _written(spark, S.bed_text(r)), "bed").select("chrom", "bgn", "end_", F.size("fields").alias("n_fields"))


@query(f"with {of_length(9)} select kmer, count(*) as value from can where kmer between 'ACC' and 'CAT' group by kmer")
def src15_kmer_table(spark, d):
    """A sorted table written in ranges; of its files only those between two k-mers are read back."""
    at = scratch(spark)
    kmers.write(kmers.count(reads(spark, d), 9), at, 8)
    return kmers.read(spark, at, "ACC", "CAT")


@query("select s_suppkey, concat('  ', s_name) as line from supplier")
def src13_lines(spark, d):
    """Lines without the white space at their ends; that at their beginnings stays."""
    lines = S.read_lines(spark, _written(spark, table(spark, d, "supplier").select(F.concat(F.lit("  "), "s_name", F.lit(" \t ")).alias("value"))))
    return lines.select(F.regexp_extract("line", "#([0-9]+)$", 1).cast("long").alias("s_suppkey"), "line")


@query("select cast(1 as bigint) as files, cast(sum(length(n_name) + 1) as bigint) as size, md5(string_agg(n_name || chr(10), '' order by n_nationkey)) as digest from nation")
def src28_digests(spark, d):
    """How many files, their size and the digest of what they hold."""
    at = _written(spark, table(spark, d, "nation").coalesce(1).orderBy("n_nationkey").select("n_name").coalesce(1))
    return S.file_digests(spark, at).filter("size > 0").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.max("md5").alias("digest"))


# ---- longer sequences: whole texts as bases ----
LETTERS = "translate(regexp_replace(lower(text), '[^a-z .,]', 'x'{g}), 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTACGTACGTACGTACGTACGTACGTA')"


@query(f"with s as (select doc_id, {LETTERS.format(g=', ' + chr(39) + 'g' + chr(39))} as s from documents), c as (select substr(s, cast(i as int) + 1, 520) as piece from (select s, unnest(range(0, length(s), 500)) as i from s) x), "
       "w as (select substr(piece, cast(j as int) + 1, 21) as fwd from (select piece, unnest(range(0, least(500, length(piece) - 20))) as j from c where length(piece) >= 21) x), "
       "k as (select least(translate(fwd, 'ACTG', '0123'), translate(reverse(translate(fwd, 'ACGT', 'TGCA')), 'ACTG', '0123')) as kmer from w) select translate(kmer, '0123', 'ACTG') as kmer, count(*) as value from k group by kmer having count(*) > 1")
def kmer10_whole_texts(spark, d):
    """Canonical 21-mers of whole texts that occur more than once."""
    r = table(spark, d, "documents").selectExpr("doc_id as seq_idx", LETTERS.format(g="") + " as bases")
    return kmers.value_range(kmers.count(r, 21, least=2), 2)


@query("select l_suppkey as grp, count(*) as n from lineitem where l_orderkey < l_suppkey * 100 + 250 and l_orderkey >= l_suppkey * 100 group by l_suppkey")
def join09_starts(spark, d):
    """Records that begin within a region, the second definition of touching it."""
    left = table(spark, d, "lineitem").selectExpr("l_suppkey as grp", "l_orderkey as bgn", "l_orderkey + cast(l_quantity as bigint) as end_", ROW + " as id")
    right = table(spark, d, "supplier").selectExpr("s_suppkey as grp", "s_suppkey * 100 as beg2", "s_suppkey * 100 + 250 as end2")
    return intervals.touching(left, right, 256, by="start").groupBy("grp").agg(F.count("*").alias("n"))


@query("with t as (select l_suppkey, count(*) filter (where l_linenumber % 2 = 0 and l_linestatus = 'F') as a, count(*) filter (where l_linenumber % 2 = 0 and l_linestatus = 'O') as b, count(*) filter (where l_linenumber % 2 = 1 and l_linestatus = 'F') as c, count(*) filter (where l_linenumber % 2 = 1 and l_linestatus = 'O') as d from lineitem group by l_suppkey), "
       "k as (select *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) as k from t), p as (select *, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) as p from k), "
       "o as (select l_suppkey, p as own from p where k = a) select p.l_suppkey, round(sum(p) filter (where k <= a), 8) as lower, round(sum(p) filter (where k >= a), 8) as upper, round(least(1.0, sum(p) filter (where p <= own * (1 + 1e-9))), 8) as two from p join o on p.l_suppkey = o.l_suppkey group by p.l_suppkey")
def agg18_fisher(spark, d):
    """Fisher's exact test of line number parity against line status, per supplier."""
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.count_if((F.col("l_linenumber") % 2 == i) & (F.col("l_linestatus") == s)).alias(f"n{i + 1}{j}") for i in (0, 1) for j, s in ((1, "F"), (2, "O"))))
    return stats.fisher(t).select("l_suppkey", *(F.round(c, 8).alias(c) for c in ("lower", "upper", "two")))


TERMS = "f as (select * from (values " + ", ".join(f"({k}, {v})" for k, v in enumerate((1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711, 28657, 46368, 75025, 121393, 196418, 317811, 514229, 832040, 1346269))) + ") t(k, v))"


@query(f"with recursive {TERMS}, z as (select s_suppkey as x, s_suppkey as left_, 29 as k, '' as code from supplier where s_suppkey > 0 union all select x, case when left_ >= v then left_ - v else left_ end, z.k - 1, case when left_ >= v then '1' || code when code = '' then '' else '0' || code end from z join f on f.k = z.k) select x, code || '1' as code from z where k = -1")
def cod05_zeckendorf(spark, d):
    from ..functions import bits

    x = F.col("s_suppkey")
    return table(spark, d, "supplier").filter("s_suppkey > 0").select(x.alias("x"), bits.zeckendorf(x).alias("code"))


def _times(x, c):
    return f"(({x}) * {c}::hugeint) % 4294967296"


def _turn(x, r):
    return f"((({x}) << {r}) % 4294967296 + (({x}) >> {32 - r}))"


STEPS = "".join(f", k{i} as (select *, {_times(_turn('a', text.HASH_WORD_TURN), text.HASH_WORD[1])} as k from (select *, {_times(w, text.HASH_WORD[0])} as a from h{i}) t), h{i + 1} as (select x, ({_times(_turn('b', text.HASH_TURN), text.HASH_FACTOR)} + {text.HASH_ADDED}) % 4294967296 as h from (select *, xor(h::bigint, k::bigint)::hugeint as b from k{i}) t)" for i, w in enumerate(("x::hugeint", "(x * 7)::hugeint", "3::hugeint")))


@query(f"with h0 as (select s_suppkey as x, {text.HASH_SEED}::hugeint as h from supplier){STEPS}, e1 as (select x, xor(h::bigint, 3) as h from h3), e2 as (select x, xor(h, h >> 16) as h from e1), e3 as (select x, ({_times('h', text.HASH_END[0])})::bigint as h from e2), "
       f"e4 as (select x, xor(h, h >> 13) as h from e3), e5 as (select x, ({_times('h', text.HASH_END[1])})::bigint as h from e4) select x, xor(h, h >> 16) as hash from e5")
def hash01_words(spark, d):
    x = F.col("s_suppkey").cast("long")
    return table(spark, d, "supplier").select(x.alias("x"), text.word_hash(F.array(x, x * 7, F.lit(3).cast("long"))).alias("hash"))


SPECIAL = "t as (select s_suppkey, cast(s_suppkey % 9 + 1 as int) as a, cast(s_suppkey % 7 + 1 as int) as b, abs(s_acctbal) / 1000 as x, (s_suppkey % 101) / 101.0::double as y from supplier)"


@query(f"with {SPECIAL} select s_suppkey, round(1 - exp(-x) * list_sum([pow(x, k) / exp(lgamma(k + 1)) for k in range(0, a)]), 8) as gamma, round(list_sum([exp(lgamma(a + b) - lgamma(k + 1) - lgamma(a + b - k)) * pow(y, k) * pow(1 - y, a + b - 1 - k) for k in range(a, a + b)]), 8) as beta, "
       "round(1 - 2 / sqrt(pi()) * list_sum([pow(-1, n) * pow(2 * y, 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1)) for n in range(0, 40)]), 8) as erfc, round(lgamma(a + 0.5), 8) as log_gamma from t")
def agg18_special(spark, d):
    """Shares of the gamma and beta functions, of whole parameters as sums; the complement of the error function; log gamma."""
    t = table(spark, d, "supplier").selectExpr("s_suppkey", "cast(s_suppkey % 9 + 1 as int) as a", "cast(s_suppkey % 7 + 1 as int) as b", "abs(s_acctbal) / 1000 as x", "(s_suppkey % 101) / 101.0D as y")
    a, b, x, y = (F.col(c) for c in "abxy")
    return t.select("s_suppkey", F.round(special.gamma_below(a, x), 8).alias("gamma"), F.round(special.beta_below(a, b, y), 8).alias("beta"), F.round(special.erfc(2 * y), 8).alias("erfc"), F.round(special.log_gamma(a + 0.5), 8).alias("log_gamma"))
