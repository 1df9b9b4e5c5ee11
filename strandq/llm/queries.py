"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, gif, line_dedup, ngram_join, packing, resample, runs, secrets, sharding, substrings, toxicity, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and leaked benchmark item."""
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.withColumn("score", F.round("score", 6))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that occur in more than one document."""
    return substrings.repeated_spans(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs.select("doc_id", "text"), toxicity.train(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: A dated list made from the pages themselves: hosts, domains and folders, on days given by a digest.
_DAY = "cast(conv(substring(md5(concat('{0}', name)), 1, 4), 16, 10) as int)"


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with a day of capture, and entries: added, added again, taken off, added once more; deep folders, capitals, removals of what isn't there."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("cast(page_id * 7919 % 400 as int)").alias("at"))
    host = url_filters.host(F.col("url"))
    folder = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/([^/?#]+)/[0-9]", 1)
    number = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/[^/?#]+/([^/?#]+)", 1)
    hosts = pages.select(host.alias("name")).filter("name <> ''").distinct()
    wide = hosts.select(F.regexp_extract("name", r"([^.]+\.[^.]+)$", 1).alias("name")).distinct()
    first = pages.select(F.concat_ws("/", host, folder).alias("name")).filter(folder != "").distinct()
    deep = pages.select(F.concat_ws("/", host, folder, number).alias("name")).filter((folder != "") & (number != "")).distinct()
    day = lambda salt: F.expr(_DAY.format(salt))
    dated = lambda rows, key, name, n, turns: rows.filter(day("p") % n == 0).select(key.alias("key"), name.alias("list"), F.explode(F.array(*(F.struct(at.cast("int").alias("at"), F.lit(what).alias("action")) for at, what in turns))).alias("e")).select("key", "list", "e.*")
    k = F.col("name")
    a, b = day("a") % 200, day("b") % 60
    turns = [(a, "add"), (a + b, "add"), (a + 100, "remove"), (a + 130, "remove"), (a + 160, "add"), (a + 160 + b, "remove")]
    every = [
        dated(hosts, F.when(a % 2 == 0, k).otherwise(F.upper(k)), F.when(day("l") % 2 == 0, "spam").otherwise("adult"), 3, turns),
        dated(wide, k, F.lit("wide"), 1, [(a, "add"), (a + 90, "remove"), (a + 90, "add")]),
        dated(first, k, F.lit("pages"), 2, turns),
        dated(first, F.upper(k), F.lit("capitals"), 2, [(a, "add")]),
        dated(deep, k, F.lit("page"), 5, [(b, "remove"), (a, "add")]),
        dated(deep, F.concat(k, F.lit("/a/b")), F.lit("deeper"), 3, [(a, "add")]),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return pages, out


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the list entries that were in force on the day of its capture."""
    return url_filters.evaluate(*_captures(spark, sf_dir)).select("page_id", "at", "n_active", "lists", "matched")


# Held against the dated entries themselves: the last one of a key and list up to the day of capture decides.
OP6_SQL = r"""
with pages1 as (
  select page_id, url, cast(page_id * 7919 % 400 as int) as at, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) as host,
         regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)/[0-9]', 1) as folder, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/[^/?#]+/([^/?#]+)', 1) as number,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^?#]*)', 1), '/'), lambda x: x <> '') as path
  from pages),
names as (
  select distinct 'host' as kind, host as name from pages1 where host <> ''
  union select 'wide', regexp_extract(host, '([^.]+\.[^.]+)$', 1) from pages1
  union select 'first', host || '/' || folder from pages1 where folder <> ''
  union select 'deep', host || '/' || folder || '/' || number from pages1 where folder <> '' and number <> ''),
d as (select kind, name, {p} as p, {l} as l, {a} % 200 as a, {b} % 60 as b from names),
six as (select kind, name, p, l, a, unnest([[a, 1], [a + b, 1], [a + 100, 0], [a + 130, 0], [a + 160, 1], [a + 160 + b, 0]]) as e from d),
entries as (
  select name as key, case when l % 2 = 0 then 'spam' else 'adult' end as list, e[1] as day, e[2] as on_ from six where kind = 'host' and p % 3 = 0
  union all select name, 'pages', e[1], e[2] from six where kind = 'first' and p % 2 = 0
  union all select name, 'wide', a, 1 from d where kind = 'wide'
  union all select name, 'wide', a + 90, 0 from d where kind = 'wide'
  union all select lower(split_part(name, '/', 1)) || '/' || upper(split_part(name, '/', 2)), 'capitals', a, 1 from d where kind = 'first' and p % 2 = 0
  union all select name, 'page', b, 0 from d where kind = 'deep' and p % 5 = 0
  union all select name, 'page', a, 1 from d where kind = 'deep' and p % 5 = 0
  union all select name || '/a/b', 'deeper', a, 1 from d where kind = 'deep' and p % 3 = 0),
days as (select key, list, day, min(on_) as on_ from entries group by key, list, day),
asked as (
  select p.page_id, p.at, unnest(list_distinct(list_concat(
    [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, greatest(len(string_split(host, '.')), 2))],
    [case when i = 0 then host else host || '/' || array_to_string(path[1:i], '/') end for i in range(0, len(path) + 1)]))) as key
  from pages1 p where host <> ''),
last as (select a.page_id, d.key, d.list, arg_max(d.on_, d.day) as on_ from asked a join days d on d.key = a.key and d.day <= a.at group by a.page_id, d.key, d.list),
found as (
  select page_id, count(*) as n, string_agg(distinct list, ',' order by list) as lists, max(lpad(cast(length(key) as varchar), 6, '0') || key) as best
  from last where on_ = 1 group by page_id)
select p.page_id, p.at, coalesce(f.n, 0) as n_active, f.lists as lists, substr(f.best, 7) as matched from pages1 p left join found f on p.page_id = f.page_id
""".format(**{k: f"cast('0x' || substr(md5('{k}' || name), 1, 4) as int)" for k in "plab"})


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    out = chat.render(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "copies", F.md5("chat").alias("chat_md5"), F.length("chat").cast("long").alias("chat_chars"))


OP7_SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as n, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) as h,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) as body
  from conversations where conv_id is not null),
p as (select conv_id, n, string_agg(h, '') over (partition by conv_id order by n) as prefix from t),
whole as (select conv_id, max(n) as n, max(prefix) as prefix from (select conv_id, n, prefix, max(n) over (partition by conv_id) as last from p) x where n = last group by conv_id),
kinds as (select prefix, n, min(conv_id) as conv_id, count(*) as copies from whole group by prefix, n),
proper as (select distinct p.prefix from p join whole w on p.conv_id = w.conv_id where p.n < w.n),
kept as (select k.conv_id, k.n, k.copies from kinds k left join proper q on k.prefix = q.prefix where q.prefix is null),
chats as (select t.conv_id, string_agg(t.body, '' order by t.n) as chat from t group by t.conv_id)
select k.conv_id, cast(k.n as bigint) as n_turns, k.copies, md5(c.chat) as chat_md5, cast(length(c.chat) as bigint) as chat_chars
from kept k join chats c on k.conv_id = c.conv_id
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gif.gif_columns(gif.gif_media(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", gif.feature(F.col("frames")).alias("feature"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


# Every pair of documents that share a shingle, and everything that can be reached from each document.
OP10_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id, doc_id as reached from documents union select r.doc_id, l.b from r join l on l.a = r.reached)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.reached) as component_id from documents d left join n on n.doc_id = d.doc_id join r on r.doc_id = d.doc_id group by d.doc_id
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
k as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from s),
n as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from k),
r as (select key, min(doc_id) as first from n where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select n.*, coalesce(r.first <> n.doc_id, false) as lost from n left join r on n.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from m group by doc_id
"""


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, some of which are made to repeat."""
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), runs.planted)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words and pairs of words."""
    out = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# The checksum is taken byte after byte by its table of 256 numbers, which its polynomial gives.
OP13_SQL = r"""
with recursive steps as (select i, i as c, 0 as k from (select unnest(range(256)) as i) x union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
w as (select source, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
      from (select 0 as source, doc_id as id, text from documents union all select 1, item_id, text from benchmark) x),
f as (select source, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from w),
n as (select source, id, f, count(*) as n from f group by all),
d as (select f, xor(list_reduce([4294967295::bigint] || list_transform(range(0, strlen(f)), lambda i: cast('0x' || substr(hex(encode(f)), cast(2 * i + 1 as int), 2) as bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as bucket
      from (select distinct f from n) x, crc),
b as (select source, id, bucket, sum(n) as n from n join d on n.f = d.f group by all),
c as (select bucket, coalesce(sum(n) filter (where source = 0), 0) as s, coalesce(sum(n) filter (where source = 1), 0) as t from b group by bucket),
g as (select bucket, cast(floor(1000 * ln((t + 1.0::double) * ((select sum(s) from c) + 10000.0::double) / ((s + 1.0::double) * ((select sum(t) from c) + 10000.0::double)))) as bigint) as gain from c),
m as (select id, sum(n) as n, cast(floor(sum(n * gain) / sum(n)::double) as bigint) as weight from b join g on b.bucket = g.bucket where source = 0 group by id),
r as (select w.id, len(w.w) as n_words, cast(coalesce(m.n, 0) as bigint) as n_features, coalesce(m.weight, 0) as weight,
      coalesce(m.weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || w.id), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score from w left join m on w.id = m.id where w.source = 0),
o as (select id, row_number() over (order by score desc, id) as rank, count(*) over () as n from r where n_words >= 20)
select r.id as doc_id, n_features, weight, score, cast(case when rank <= 25 * n // 100 then rank end as bigint) as rank from r left join o on r.id = o.id
"""


def queries() -> dict:
    every = (op1_decontaminate, op2_sharding, op3_substring_dedup, op4_packing, op5_toxicity, op6_url_filter, op7_chat, op8_secrets, op9_gif, op10_ngram_join, op11_line_dedup, op12_runs, op13_resample)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op7_chat": OP7_SQL, "op10_ngram_join": OP10_SQL, "op11_line_dedup": OP11_SQL, "op13_resample": OP13_SQL}
