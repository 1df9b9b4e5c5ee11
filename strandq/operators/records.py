"""Alignment and variant records as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences

#: The names of the bits of a record's flag.
FLAGS = {"PAIRED": 1, "PROPER_PAIR": 2, "UNMAP": 4, "MUNMAP": 8, "REVERSE": 16, "MREVERSE": 32, "READ1": 64, "READ2": 128, "SECONDARY": 256, "QCFAIL": 512, "DUP": 1024, "SUPPLEMENTARY": 2048}


def has_flags(flag: Column, all_of: int = 0, none_of: int = 0) -> Column:
    return (flag.bitwiseAND(all_of) == all_of) & (flag.bitwiseAND(none_of) == 0)


def flag_names(flag: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(flag.bitwiseAND(v) != 0, n) for n, v in FLAGS.items()]), lambda x: x.isNotNull()), ",")


def flag_mask(names: Column) -> Column:
    """The flag of names joined by commas; unknown names count for nothing."""
    return F.aggregate(F.array(*[F.when(F.array_contains(F.split(names, ","), n), v).otherwise(0) for n, v in FLAGS.items()]), F.lit(0), lambda a, v: a + v)


def variant_size(ref: Column, alt: Column) -> Column:
    """By how many bases an indel is longer than the reference, or how many bases of equally long alleles differ; 0 for others."""
    differ = F.size(F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.upper(ref.substr(i, F.lit(1))) != F.upper(alt.substr(i, F.lit(1)))))
    return F.when(variant_kind(ref, alt).isin("ref", "other"), 0).when(F.length(ref) != F.length(alt), F.length(alt) - F.length(ref)).otherwise(differ)


def variant_kind(ref: Column, alt: Column) -> Column:
    """ref, snp, mnp, indel or other."""
    plain = alt.rlike("^[ACGTNacgtn]+$")
    return F.when(alt.isin(".", "*") | (F.upper(alt) == F.upper(ref)), "ref").when(~plain, "other").when(F.length(ref) != F.length(alt), "indel").when(F.length(ref) == 1, "snp").otherwise("mnp")


def genotype_class(gt: Column) -> Column:
    """hom_ref, hom_alt, het, hap or missing of texts such as 0/1."""
    a = F.split(gt, r"[/|]")
    return F.when(gt.isNull() | F.exists(a, lambda x: x == "."), "missing").when(F.size(a) == 1, "hap").when(F.size(F.array_distinct(a)) > 1, "het").when(a[0] == "0", "hom_ref").otherwise("hom_alt")


def allele_counts(calls: DataFrame) -> DataFrame:
    """chrom, pos, an, ac (map of allele to number) of rows (chrom, pos, gt)."""
    each = calls.select("chrom", "pos", F.explode(F.split("gt", r"[/|]")).alias("allele")).filter("allele <> '.'")
    n = each.groupBy("chrom", "pos", "allele").agg(F.count("*").alias("n"))
    return n.groupBy("chrom", "pos").agg(F.sum("n").alias("an"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("allele", "n")))).alias("ac"))


def merged(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Sorted merge of many sources on key: one row per key with the 1-based numbers of the sources that have it, and their rows."""
    rows = None
    for i, s in enumerate(sources, 1):
        s = s.withColumn("source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_rows"))


def trimmed_alleles(alts: Column, calls: Column) -> tuple[Column, Column]:
    """The alternative alleles that some call uses, and the calls renumbered to them.  Calls are an array of allele
    numbers over all samples, 0 for the reference and null for missing ones."""
    used = F.array_distinct(F.filter(calls, lambda c: c > 0))
    kept = F.filter(alts, lambda _, i: F.array_contains(used, i + 1))
    return kept, F.transform(calls, lambda c: F.when(c.isNotNull(), F.size(F.filter(used, lambda u: u <= c))))


def values_of_kept(values: Column, kept: Column, alleles: Column, number: str, ploidy: int = 2) -> Column:
    """An array of values by allele, rewritten for the alleles that stay.

    kept are their old numbers in order, 0 (the reference) first; alleles is how many there were.  number R has a value per
    allele, A per alternative one, G per genotype of `ploidy` alleles: the value of alleles a <= b <= ... is at
    C(a, 1) + C(b + 1, 2) + and so on.  Arrays of another length than that, and null ones, are null.
    """

    def choose(n: Column, k: int) -> Column:
        out = F.lit(1).cast("long")
        for j in range(k):
            out = F.floor(out * (n - j) / (j + 1)).cast("long")
        return out

    if number in "RA":
        at = F.filter(F.transform(kept, lambda k: k - int(number == "A")), lambda k: k >= 0)
        size = alleles - int(number == "A")
    else:
        def places(most: Column, p: int) -> Column:
            """The places of genotypes of p of the kept alleles up to the one of that index, the last allele slowest."""
            if p == 0:
                return F.array(F.lit(0).cast("long"))
            return F.flatten(F.transform(F.sequence(F.lit(0), most.cast("int")), lambda i: F.transform(places(i, p - 1), lambda x: x + choose(F.get(kept, i).cast("long") + (p - 1), p))))

        at, size = places(F.size(kept) - 1, ploidy), choose(alleles.cast("long") + (ploidy - 1), ploidy)
    return F.when((F.size(values) == size) & (F.size(kept) > 0), F.transform(at, lambda i: F.get(values, i.cast("int"))))


def variables(sam: DataFrame) -> DataFrame:
    """Alignment records (the columns of read_sam) with what record filters ask for: endpos, ncigar, qlen, rlen, sclen, mpos,
    mrname, library, and flag_paired and so on for each flag; tags stay a map, so that [NM] is tags['NM'].

    A filter is then an expression of Spark SQL: sam.filter("mapq >= 30 and flag_paired and tags['NM'] < 3").  Undefined
    values are null; NaN, which other engines take as undefined, is made null by defined().
    """
    ops = sequences.cigar(F.col("cigar"))
    sums = sequences.totals(ops, {"query_len": "MIS=X", "ref_len": "MDN=X", "clipped": "S"})
    total = lambda k: F.coalesce(F.col(f"totals_.{k}"), F.lit(0).cast("long"))
    rlen = total("ref_len")
    named = {
        "ncigar": F.coalesce(F.size(F.split(F.regexp_replace("cigar", "[0-9]+", ""), "")) * F.when(F.col("totals_").isNotNull(), 1), F.lit(0)), "qlen": total("query_len"), "rlen": rlen, "sclen": total("clipped"), "endpos": F.col("pos") + F.greatest(rlen, F.lit(1)) - 1,
        "mpos": F.col("pnext"), "mrname": F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")), "library": F.try_element_at("tags", F.lit("LB")),
    }
    return sam.withColumn("totals_", sums).withColumns(named | {f"flag_{n.lower()}": F.col("flag").bitwiseAND(v) != 0 for n, v in FLAGS.items()}).drop("totals_")


def defined(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def byte_values(s: Column) -> Column:
    """The codes of a text's characters, of which filters take the mean, the least and the greatest."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


def byte_mean(s: Column) -> Column:
    codes = byte_values(s)
    return F.when(F.size(codes) > 0, F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c) / F.size(codes))


def has_filter(filters: Column, name: str) -> Column:
    """Whether a record has a filter; PASS and . are the same, and are what a record without filters has."""
    passed = name in ("PASS", ".")
    empty = (F.size(F.array_except(filters, F.array(F.lit("PASS"), F.lit(".")))) == 0)
    return empty if passed else F.array_contains(filters, name)


def add_filter(filters: Column, name: str) -> Column:
    """The filters with one more; PASS takes all others away, and any other takes PASS away."""
    if name in ("PASS", "."):
        return F.array(F.lit("PASS"))
    return F.array_union(F.array_except(filters, F.array(F.lit("PASS"), F.lit("."))), F.array(F.lit(name)))


def remove_filter(filters: Column, name: str) -> Column:
    """Without one; a record that loses its last filter passes."""
    left = F.array_remove(filters, name)
    return F.when(F.size(left) == 0, F.array(F.lit("PASS"))).otherwise(left)


def info_set(info: Column, key: str, values: Column) -> Column:
    """The map with a key's values set, or taken out where they are null."""
    rest = F.map_filter(info, lambda k, _: k != key)
    return F.when(values.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), values)))


def tag_set(tags: Column, key: str, value: Column) -> Column:
    """A map of tags, of their types, or of a call's values, with one set to a text, or taken out where it is null."""
    rest = F.map_filter(tags, lambda k, _: k != key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def tag_numbers(value: Column) -> Column:
    """The numbers of a tag of type B ('c,1,2' with the letter of their size), i or f; null for a null tag, and for what isn't a number."""
    parts = F.split(value, ",")
    return F.transform(F.filter(parts, lambda x, i: (i > 0) | ~x.rlike("^[cCsSiIf]$")), lambda x: x.try_cast("double"))


def header_ids(headers: DataFrame) -> DataFrame:
    """name, id, source, old: the names of several headers (source, old, name) under common ids, in the order of their first
    appearance, with the id each has in its source.  Headers are small: their distinct names meet in one window."""
    first = headers.groupBy("name").agg(F.min(F.struct("source", "old")).alias("first"))
    ids = first.select("name", (F.row_number().over(Window.orderBy("first", "name")) - 1).alias("id"))
    return headers.join(ids, "name").select("name", "id", "source", "old")


def sample_subset(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """The calls (chrom, pos, sample, gt) of some samples (sample)."""
    return calls.join(samples.select("sample").distinct(), "sample", "left_semi")


def in_order(variants: DataFrame, backward: bool = False) -> DataFrame:
    """Variants (chrom, pos, ref, alt, ...) sorted for a sweep over all of them, forward or backward; Spark sorts by ranges."""
    keys = [F.col(c) for c in ("chrom", "pos", "ref", "alt")]
    return variants.orderBy(*(k.desc() if backward else k.asc() for k in keys))


def paired_by(sources: list[DataFrame], pairing: str = "position") -> DataFrame:
    """chrom, pos, key, sources, alleles: a merge of variants (chrom, pos, ref, alt) of several sources, paired by position, by
    the kind of variant, or by the alleles themselves; alleles holds each source's different ones."""
    key = {"position": F.lit(""), "kind": variant_kind(F.col("ref"), F.col("alt")), "alleles": F.concat_ws(">", F.upper("ref"), F.upper("alt"))}[pairing]
    rows = None
    for i, s in enumerate(sources, 1):
        s = s.select("chrom", "pos", "ref", "alt", F.lit(i).alias("source"))
        rows = s if rows is None else rows.unionByName(s)
    rows = rows.withColumn("key", key)
    return rows.groupBy("chrom", "pos", "key").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.struct("source", "ref", "alt"))).alias("alleles"))


def mates_settled(bases: DataFrame) -> DataFrame:
    """bases (qname, chrom, pos, mate 1 or 2, base, qual) where both mates of a pair cover a position: equal bases count once,
    with the sum of their qualities up to 200; of different ones the better keeps four fifths of its own, and the other 0.
    Mate 1 is the one that counts if they are equal."""
    w = Window.partitionBy("qname", "chrom", "pos")
    of = lambda m, c: F.max(F.when(F.col("mate") == m, F.col(c))).over(w)
    both = bases.withColumns({"b1": of(1, "base"), "b2": of(2, "base"), "q1": of(1, "qual"), "q2": of(2, "qual")})
    first = F.col("mate") == 1
    agreed = F.when(first, F.least(F.col("q1") + F.col("q2"), F.lit(200))).otherwise(0)
    differing = F.when(first == (F.col("q1") >= F.col("q2")), F.floor(F.col("qual") * 4 / 5)).otherwise(0)
    settled = F.when(F.col("b1").isNull() | F.col("b2").isNull(), F.col("qual")).when(F.col("b1") == F.col("b2"), agreed).otherwise(differing)
    return both.withColumn("qual", settled.cast("int")).drop("b1", "b2", "q1", "q2")


def modifications(rows: DataFrame) -> DataFrame:
    """id, base, code, pos, quality: the modified bases of reads (id, seq, mm, ml) whose tags are texts such as 'C+m,5,0;' (how
    many such bases are passed over before each) and arrays of qualities; on the read as it was sequenced, pos from 0."""
    each = rows.select("id", "seq", "ml", F.posexplode(F.filter(F.split("mm", ";"), lambda g: g != "")).alias("nth", "g"), F.col("mm"))
    groups = F.filter(F.split("mm", ";"), lambda g: g != "")
    earlier = F.aggregate(F.slice(groups, F.lit(1), F.col("nth")), F.lit(0), lambda a, g: a + F.size(F.split(g, ",")) - 1)
    steps = F.transform(F.slice(F.split("g", ","), 2, F.greatest(F.size(F.split("g", ",")), F.lit(2)) - 1), lambda n: n.cast("long") + 1)
    own = F.filter(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.upper(F.col("seq").substr(i + 1, F.lit(1))) == F.substring("g", 1, 1))
    each = each.select("id", F.substring("g", 1, 1).alias("base"), F.regexp_extract("g", r"^.[+-]([^,.?]+)", 1).alias("code"), "ml", earlier.alias("earlier"), steps.alias("steps"), own.alias("own"))
    each = each.select("id", "base", "code", "ml", "earlier", "own", F.posexplode("steps").alias("k", "step"), "steps")
    nth = F.aggregate(F.slice("steps", F.lit(1), F.col("k") + 1), F.lit(0).cast("long"), lambda a, n: a + n) - 1
    return each.select("id", "base", "code", F.get("own", nth.cast("int")).alias("pos"), F.get("ml", F.col("earlier") + F.col("k")).alias("quality")).filter("pos is not null")
