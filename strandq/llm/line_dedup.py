"""Line dedup, with DataFrame functions only: lines are exploded, normalised and hashed, documents counted per hash, and
what is left of a text is put together again by position.

What travels is a pair of hashes and a position per line, which are written once and read twice; texts move once, to the positions that they lose.  A line that
very many documents have is counted with map-side combining and dealt to cells of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, copied, dealt, heavy_of, materialise, unboxed

#: Lines whose key has fewer code points are never dropped.
LEAST = 10
#: In how many documents a line must stand to be dropped from all but the first.
DOCUMENTS = 2
_BLANKS = "\x20\t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def lowered(bare: Column) -> Column:
    """A-Z lower-cased; lower() does that, and faster, where all is ASCII."""
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _CAPITALS, _CAPITALS.lower()))


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, k (a hash of the text), pos (from 0), h1 and h2 (128 bits of the key) of each line whose key has at least
    `least` code points; rows without doc_id have none."""
    split = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = split.filter(F.char_length(bare(F.col("line"))) >= least).select("doc_id", "k", "pos", lowered(bare(F.col("line"))).alias("key"))
    return key.select("doc_id", "k", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, k, lost: the positions of the lines that a text loses, for texts that lose any."""
    key, every = ["h1", "h2"], materialise(lines(docs, least))
    many = every.groupBy(*key).agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    many = materialise(many.filter(F.col("documents") >= documents).select(*key, "first", "n"))
    hot = heavy_of(many, key, many.agg(F.sum("n")).first()[0] or 0)
    found = dealt(every, hot, key, "doc_id", "pos").join(copied(many.drop("n"), hot, key), [*key, "cell"]).filter("doc_id <> first")
    return found.groupBy("doc_id", "k").agg(F.collect_set("pos").alias("lost"))  # as many as a text has lines, however often the row is repeated


def drop_repeated_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """docs with text without the lines whose key at least `documents` documents have, but for the first of these (by
    doc_id), which keeps all of them; with n_lines, how many there were, and n_dropped.

    Null and empty texts have one empty line; null texts stay null.  Rows of one doc_id are one document, each row with
    its own text; repeated rows lose the same lines.  Rows without doc_id stay whole and don't count.  Lines and texts can
    be of any length.  Columns of docs may have any name; those named like the new ones are replaced.  An empty table gives
    an empty result.
    """
    rows = boxed(docs, doc_id=F.col("doc_id").cast("long"), k=F.xxhash64("text")).join(dropped(docs, least, documents), ["doc_id", "k"], "left")
    split = F.split(F.coalesce(F.col("row_.text"), F.lit("")), "\n")
    n = F.size(split)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    # The split text is the variable of a lambda, so that it is split once and not once for each line.
    again = F.transform(F.array(split), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))[0]
    text = F.when(F.col("lost").isNull(), F.col("row_.text")).otherwise(again)
    # A text without lost lines isn't split again: its line ends are counted.
    ends = F.coalesce(F.char_length("row_.text") - F.char_length(F.replace(F.col("row_.text"), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    return unboxed(rows, docs.columns, text=text, n_lines=ends.cast("long"), n_dropped=F.coalesce(F.size("lost"), F.lit(0)).cast("long"))
