"""URL filters as a temporal list join, with DataFrame functions only.

Dated list entries (a key is put on a list or taken off) become validity intervals; an as-of join evaluates every
capture against the entries that were active when it was fetched.  Keys are hosts, parent domains, and hosts with any
number of leading path folders; hosts in either case, folders as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, copied, dealt, heavy, materialise, unboxed

#: Captures of one key are split into cells of at least this many rows, and of a like share of all captures at any size.
CELL = 128
#: Into how many parts the captures of one URL and time are dealt.
SALTS = 64


def intervals(entries: DataFrame) -> DataFrame:
    """key, list, since, until (null: still active) of entries (key, list, at, action).

    action 'add' or 'remove' at time `at` holds until the next entry of the same key and list; of several at one time a
    removal wins; repeated additions merge into one interval.  Rows with a null in any of the four have no effect.
    """
    w = Window.partitionBy("key", "list").orderBy("at")
    at = entries.filter("key is not null and list is not null and at is not null and action in ('add', 'remove')")
    name = F.substring_index("key", "/", 1)
    at = at.groupBy(F.concat(F.lower(name), F.substr("key", F.length(name) + 1)).alias("key"), "list", "at").agg(F.max("action").alias("action"))
    turns = at.withColumn("was", F.lag("action", 1, "remove").over(w)).filter("was <> action")
    return turns.withColumn("until", F.lead("at").over(w)).filter("action = 'add'").select("key", "list", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def keys(url: Column, folders: int | None = None) -> Column:
    """The keys that can match a URL: its host, parent domains of two labels or more (addresses have none), and host with 1 to `folders` folders (None: all)."""
    h = host(url)
    labels = F.split(h, r"\.")
    outer = F.when(h.rlike(r"^[0-9.]+$|^\["), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    parents = F.transform(F.sequence(F.lit(1), outer), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1), "/"), lambda x: x != "")
    deep = F.transform(F.sequence(F.lit(0), F.size(path) if folders is None else F.least(F.size(path), F.lit(folders))), lambda i: F.concat_ws("/", h, F.slice(path, 1, i)))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, deep)))


def in_force(asked: DataFrame, valid: DataFrame, rows: int) -> DataFrame:
    """key, list and the other columns of asked (key, t, ...) for each list that the key is on at time t.

    Captures meet the lists of their key, and per key and list both sides are put in the order of time, so that each
    capture looks at the last interval that began, however many there are.  Keys of more than a share of all `rows` are
    dealt to several cells, to each of which their intervals are copied; there are at most as many such keys as skew.heavy
    says, times the keys of a URL.
    """
    hot = heavy(asked, ["key"], rows, CELL)
    rest = [c for c in asked.columns if c != "key"]
    met = dealt(asked, hot, ["key"], *rest).join(copied(valid.select("key", "list").distinct(), hot, ["key"]), ["key", "cell"])
    begun = copied(valid, hot, ["key"]).select("key", "cell", "list", F.col("since").alias("t"), F.struct("since", "until").alias("span"))
    w = Window.partitionBy("key", "cell", "list").orderBy("t", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = met.unionByName(begun, allowMissingColumns=True).withColumns({"last": F.last("span", True).over(w), "asks": F.col("span").isNull()})
    return every.filter("asks and last is not null and (last.until is null or t < last.until)").select("key", "list", *rest)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "at") -> DataFrame:
    """Each row of captures with n_active (entries in force at that time), lists (their names, sorted) and matched (the longest key).

    Intervals include their start and not their end.  Captures with a null URL or time, or without a host, match nothing;
    repeated rows come back with equal results, and empty tables give no rows or no matches.  Columns of captures may
    have any name; those named like the three new ones are replaced.
    """
    deepest = entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    valid = materialise(intervals(entries))
    # A page that is fetched again and again at one time is told apart by its other columns, so that it isn't one group.
    u, t = F.col(f"`{url}`"), F.col(f"`{at}`")
    other = [F.col(f"`{n}`") for n, kind in captures.dtypes if "map<" not in kind and "variant" not in kind]
    name = {"h0": F.xxhash64(F.lit(1), u, t), "h1": F.xxhash64(F.lit(2), u, t), "salt": F.pmod(F.xxhash64(*other), F.lit(SALTS)).cast("int")}
    fetched = captures.select(*(c.alias(k) for k, c in name.items()), t.alias("t"), u.alias("url")).filter("url is not null and t is not null").distinct()
    hits = in_force(fetched.select(*name, "t", F.explode(keys(F.col("url"), deepest)).alias("key")), valid, captures.count())
    found = hits.groupBy(*name).agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max(F.struct(F.length("key"), "key"))["key"].alias("matched"))
    out = boxed(captures, **name).join(found, list(name), "left")
    return unboxed(out, captures.columns, n_active=F.coalesce("n_active", F.lit(0)), lists=F.col("lists"), matched=F.col("matched"))
