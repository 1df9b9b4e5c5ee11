"""Registered queries of single-row functions, paths, random numbers and coverage peaks; importing this module adds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, random_numbers, text, times
from ..operators import alignment, kmers, records
from .registry import PR, SMOOTH, STRETCHES, of_length, pr, query, reads, table

# A number whose highest bit can be set, in Spark (long) and in SQL (as text of 64 bits).
WIDE = "o_orderkey * 40503 + 12345"
BITS = f"b as (select o_orderkey as x, lpad(bin({WIDE}), 64, '0') as t from orders)"


def _wide():
    return F.col("o_orderkey") * 40503 + 12345


@query(f"with {BITS} select x, repeat('0', 40) || substr(t, 41) as no_left, substr(t, 1, 40) || repeat('0', 24) as only_left, substr(t, 1, 54) || repeat('0', 10) as no_right, repeat('0', 54) || substr(t, 55) as only_right, "
       "repeat('0', 40) || substr(t, 41, 14) || repeat('0', 10) as middle, substr(t, 1, 40) || repeat('0', 14) || substr(t, 55) as outside from b")
def bit02_parts(spark, d):
    v = _wide()
    shown = {"no_left": bits.clear_left(v, 40), "only_left": bits.keep_left(v, 40), "no_right": bits.clear_right(v, 10), "only_right": bits.keep_right(v, 10), "middle": bits.keep_middle(v, 40, 10), "outside": bits.clear_middle(v, 40, 10)}
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("x"), *[bits.binary(c, 64).alias(k) for k, c in shown.items()])


@query(f"with {BITS} select x, substr(t, 8) || substr(t, 1, 7) as to_left, substr(t, 58) || substr(t, 1, 57) as to_right, repeat('0', 44) || repeat('1', 20) as low from b")
def bit03_rotations(spark, d):
    v = _wide()
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("x"), bits.binary(bits.rotate_left(v, 7), 64).alias("to_left"), bits.binary(bits.rotate_right(v, 7), 64).alias("to_right"), bits.binary(bits.low_mask(F.lit(20)), 64).alias("low"))


@query(f"with h as (select o_orderkey as x, lpad(hex({WIDE}), 16, '0') as h from orders) select x, substr(h, 15, 2) || substr(h, 13, 2) as two, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) as four, "
       "substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) as eight from h")
def bit05_byte_order(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("x"), *[bits.swapped_bytes(_wide(), n).alias(k) for k, n in (("two", 2), ("four", 4), ("eight", 8))])


@query("select o_orderkey as x, list_sum([((o_orderkey >> (2 * i)) & 3) << (3 * i) for i in range(0, 20)])::bigint as three, o_orderkey as back from orders")
def bit07_expand(spark, d):
    x = F.col("o_orderkey")
    return table(spark, d, "orders").select(x.alias("x"), bits.two_to_three(x).alias("three"), bits.three_to_two(bits.two_to_three(x)).alias("back"))


@query(f"with b as (select o_orderkey as x, cast(o_orderkey % 128 as int) as i, lpad(bin({WIDE}), 64, '0') || lpad(bin(o_orderkey), 64, '0') as t from orders) "
       "select x, cast(substr(t, i + 1, 1) as int) as got, substr(t, 1, i) || '1' || substr(t, i + 2) as set1, substr(t, 1, i) || '0' || substr(t, i + 2) as set0, substr(t, 1, i) || case substr(t, i + 1, 1) when '0' then '1' else '0' end || substr(t, i + 2) as flipped from b")
def bit08_bit_array(spark, d):
    x, i = F.col("o_orderkey"), F.col("o_orderkey") % 128
    w = F.array(_wide(), x)
    shown = lambda a: F.array_join(F.transform(a, lambda v: bits.binary(v, 64)), "")
    return table(spark, d, "orders").select(x.alias("x"), bits.get_bit(w, i).alias("got"), shown(bits.set_bit(w, i, True)).alias("set1"), shown(bits.set_bit(w, i, False)).alias("set0"), shown(bits.flip_bit(w, i)).alias("flipped"))


@query("select doc_id, rtrim(concat(lang, '  ')) as chomped, trim(concat('  ', source, ' ')) as trimmed, replace(replace(concat(lang, chr(10), source, chr(9)), chr(10), '<LF>'), chr(9), '<TAB>') as shown from documents")
def str01_trims(spark, d):
    return table(spark, d, "documents").select("doc_id", text.chomp(F.concat("lang", F.lit(" \t\n"))).alias("chomped"), text.trimmed(F.concat(F.lit("  "), "source", F.lit(" "))).alias("trimmed"), text.visible(F.concat("lang", F.lit("\n"), "source", F.lit("\t"))).alias("shown"))


@query("select p_partkey, p_name as value, cast(p_partkey as varchar) as key, true as alone from part")
def str03_key_values(spark, d):
    k = F.col("p_partkey").cast("string")
    kv = text.key_value(F.concat(k, F.lit(" := "), "p_name", F.lit("  # end")))
    return table(spark, d, "part").select("p_partkey", kv["value"].alias("value"), kv["key"].alias("key"), text.key_value(k).isNull().alias("alone"))


@query("with w as (select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as w from pages) select page_id, w[1] as first, w[-1] as last, len(w) as n, array_to_string(w[2:], ' ') as shifted, array_to_string(w[:-2], ' ') as popped from w")
def str05_word_ends(spark, d):
    w = text.words(F.col("url"), "/")
    return table(spark, d, "pages").select("page_id", F.get(w, F.lit(0)).alias("first"), F.try_element_at(w, F.lit(-1)).alias("last"), F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), " ").alias("shifted"), F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ").alias("popped"))


@query("with t as (select o_orderkey as x, hex(o_orderkey) as h, bin(o_orderkey) as b, cast(o_totalprice as varchar) as p from orders) "
       "select x, regexp_full_match(b, '[01]+') as is_bin, regexp_full_match(h, '[0-7]+') as is_oct, regexp_full_match(h, '[0-9]+') as is_dec, regexp_full_match(h || 'g', '[0-9A-Fa-f]+') as is_hex, true as dotted, false as signed from t")
def str07_number_tests(spark, d):
    x = F.col("o_orderkey")
    return table(spark, d, "orders").select(x.alias("x"), text.of_class(F.bin(x), "bin").alias("is_bin"), text.of_class(F.hex(x), "oct").alias("is_oct"), text.of_class(F.hex(x), "dec").alias("is_dec"), text.of_class(F.concat(F.hex(x), F.lit("g")), "hex").alias("is_hex"),
                                            text.is_decimal(F.concat(x.cast("string"), F.lit(".5."))).alias("dotted"), text.is_decimal(F.concat(F.lit("-"), x.cast("string"))).alias("signed"))


@query("select o_orderkey, o_orderkey as whole, ' rest' as behind, -o_orderkey - 0.25::double as number, cast(null as double) as none from orders")
def str09_leading_numbers(spark, d):
    k = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", text.leading_integer(F.concat(k, F.lit(" rest"))).alias("whole"), text.behind_number(F.concat(F.lit(" "), k, F.lit(" rest"))).alias("behind"), text.leading_number(F.concat(F.lit(" -"), k, F.lit(".25x"))).alias("number"), text.leading_number(F.concat(F.lit("x"), k)).alias("none"))


@query("select o_orderkey, lpad(bin(o_orderkey), 40, '0') as two, lower(hex(o_orderkey)) as sixteen, lpad(cast(o_orderkey as varchar), 12, '0') as ten, floor(o_orderkey * 4096 / 8) / 1048576.0::double as mb from orders")
def str12_bases(spark, d):
    x = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", text.in_base(x, 2, 40).alias("two"), text.in_base(x, 16).alias("sixteen"), text.in_base(x, 10, 12).alias("ten"), text.megabytes(x * 4096).alias("mb"))


@query("select page_id, url as decoded, url as from_64 from pages")
def str16_decoding(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.percent_decoded(F.replace(F.url_encode(u), F.lit("+"), F.lit("%20"))).alias("decoded"), F.unbase64(F.base64(F.encode(u, "UTF-8"))).cast("string").alias("from_64"))


@query("select l_orderkey * 8 + l_linenumber as id, cast(round_even(l_quantity / 2, 0) as bigint) as halves from lineitem")
def math02_half_even(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.rint(F.col("l_quantity").cast("double") / 2).cast("long").alias("halves"))


@query("with t as (select event_id, date_trunc('second', ts + interval 500 milliseconds) as t from events) select event_id, year(t)::int as y, month(t)::int as mo, day(t)::int as dd, hour(t)::int as h, minute(t)::int as mi, second(t)::int as s, 4102444800 - cast(epoch(t) as bigint) as age from t")
def time01_parts(spark, d):
    e = table(spark, d, "events").select("event_id", times.rounded(F.col("ts")).alias("t"))
    return e.select("event_id", *(c.alias(k) for k, c in times.split(F.col("t")).items()), times.age(F.col("t"), F.timestamp_seconds(F.lit(4102444800))).alias("age"))


@query(f"with {PR} select id, levenshtein(a, b) as distance, levenshtein(a, b) as edits, a, b from pr")
def aln04_global_paths(spark, d):
    """The path's edits are as many as the distance, and the shown texts without gaps are the pair."""
    r = pr(spark, d).withColumn("r", alignment.edit_paths(F.col("a"), F.col("b"))).withColumn("s", alignment.path_summary(F.col("r.cigar")))
    bare = lambda c: F.upper(F.replace(F.col(c), F.lit("-"), F.lit("")))
    return r.select("id", F.col("r.distance").cast("long").alias("distance"), F.expr("s.mismatches + s.inserted + s.deleted").cast("long").alias("edits"), bare("r.shown_a").alias("a"), bare("r.shown_b").alias("b"))


@query(f"with {STRETCHES} select id, min(dist) as distance, min(dist) as at_place, arg_min(stop, dist * 100 + stop) as end_ from w group by id")
def aln03_infix_places(spark, d):
    """The stretch of b between the found start and the first end has the found distance from a."""
    r = pr(spark, d).withColumn("r", alignment.edit_paths(F.col("a"), F.col("b"), "infix"))
    return r.select("id", F.col("r.distance").cast("long").alias("distance"), F.expr("levenshtein(a, substr(b, r.bgn + 1, r.end_ - r.bgn))").cast("long").alias("at_place"), F.col("r.end_").cast("long").alias("end_"))


@query("select o_orderkey as id, case when o_orderkey % 3 = 0 then 'A' else 'A,C' end as alts, case when o_orderkey % 3 = 0 then '0,1,.' else '0,2,1' end as calls from orders")
def var01_trimmed_alleles(spark, d):
    third = F.col("o_orderkey") % 3 == 0
    alts = F.when(third, F.array(F.lit("G"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("C")))
    calls = F.when(third, F.array(F.lit(0), F.lit(2), F.lit(None).cast("int"))).otherwise(F.array(F.lit(0), F.lit(2), F.lit(1)))
    kept, new = records.trimmed_alleles(alts, calls)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(kept, ",").alias("alts"), F.array_join(new.cast("array<string>"), ",", ".").alias("calls"))


@query()
def rng01_numbers(spark, d):
    n = table(spark, d, "supplier").select("s_suppkey", random_numbers.twister(F.col("s_suppkey"), 16).alias("y"))
    return n.select("s_suppkey", "y", random_numbers.real_open(F.col("y")[0]).alias("open"), random_numbers.real_53(F.col("y")[0], F.col("y")[1]).alias("fine"), random_numbers.exponential(F.col("y")[0], 1.0, 2.0).alias("waiting"), random_numbers.gaussian(F.col("y")).alias("normal"))


K7 = of_length(7)
TURNS = ("{1}a as (select value, height, lag(height) over (order by value) as old from {0}), {1}b as (select value, height, lag(height) over (order by value) as l, lead(height) over (order by value) as r, lead(value) over (order by value) as stop from {1}a where old is null or old <> height), "
         "{1} as (select value, case when stop = value + 1 then value + (l - r) / (2 * (l - 2 * height + r)) else (value + stop - 1) / 2 end as spot, case when height > l and height > r then 'peak' else 'trough' end as kind from {1}b where ((height > l and height > r) or (height < l and height < r)) and value between 3 and 99)")


@query(f"with {K7}, w as (select kmer, count(*) as value from can group by kmer), small as (select value, count(*) as n from w where value < 1024 group by value), dense as (select g.value, coalesce(n, 0)::double as height from (select unnest(range(1, 1024)) as value) g left join small s on g.value = s.value), "
       f"o as (select unnest(range(-9, 10)) as o), even as (select a.value, round(sum(b.height * {SMOOTH}), 6) as height from dense a join o on true join dense b on b.value = a.value + o.o group by a.value), {TURNS.format('dense', 'tr')}, {TURNS.format('even', 'te')}, "
       "tops as (select te.value, te.spot, d.height, row_number() over (order by te.value) as peak from te join dense d on d.value = te.value where te.kind = 'peak'), found as (select peak, spot, height from tops where peak <= 8 union all select 0, min(spot), -1 from tr where kind = 'trough'), "
       "high as (select arg_max(peak, height * 100 - peak) as top from found) select cast(s.peak as int) as peak, s.peak / pow(2, greatest(top, 1) - 1) as ploidy, round(coalesce(spot, 0), 4) as coverage from (select unnest(range(0, 9)) as peak) s left join found f on f.peak = s.peak join high on true where exists (select 1 from small)")
def agg06_peaks(spark, d):
    """Coverage peaks of the histogram of 7-mer counts."""
    return kmers.peaks(kmers.histogram(kmers.count(reads(spark, d), 7))).withColumn("coverage", F.round("coverage", 4))
