"""Chat formatting after a cumulative-snapshot collapse.

A log often holds a conversation again after each turn.  Rolling hashes of all prefixes of turns identify those that
are a prefix of a longer one; an anti-join keeps the maximal ones, equal ones once, and these are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|", "|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n, last, h1, h2: two sums of the hashes of the first n turns, each hash of position, role and text; a sum
    over a window rolls them forward; last tells the last turn.  Turns count in the order of (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = turns.select("conv_id", "turn", *(c.alias(k) for k, c in zip(("role", "text"), said, strict=True))).withColumns({"n": F.row_number().over(order), "last": F.lead(F.lit(False), 1, True).over(order)})
    some = lambda seed: F.xxhash64(F.lit(seed), "n", "role", "text").cast("decimal(20,0)")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("conv_id", "n", "last", F.sum(some(1)).over(running).alias("h1"), F.sum(some(2)).over(running).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that are no proper prefix of another; of equal ones the smallest conv_id stands for all."""
    each = prefix_hashes(turns.filter("conv_id is not null"))
    own = ["n", "h1", "h2"]
    kinds = each.filter("last").groupBy(*own).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = each.filter("not last").select(*own).distinct()
    return kinds.join(proper, own, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "copies")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE + "\n"), F.coalesce(text, F.lit("")), F.lit("\n" + OPEN + "end" + CLOSE + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, chat for each maximal conversation of turns (conv_id, turn, role, text).

    Null roles and texts count as empty; turns without conv_id belong to no conversation; turns with equal numbers are
    ordered by role and text, and repeated rows are turns of their own.  Further columns don't matter; an empty table
    gives an empty result.  A conversation, as long as it may be, becomes one text, so it is put together in one task.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = said.join(maximal(turns), "conv_id")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(parts, lambda t: turn_text(t["role"], t["text"])), "")
    return own.groupBy("conv_id", "n_turns", "copies").agg(body.alias("chat"))
