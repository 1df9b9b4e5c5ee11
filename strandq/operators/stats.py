"""Moments, order statistics and weighted histograms per group grp of values x."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def moments(rows: DataFrame) -> DataFrame:
    """grp, n, mean, variance, deviation with n - 1; 0 for a single value."""
    return rows.groupBy("grp").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("deviation"))


def retract(rows: DataFrame) -> DataFrame:
    """Moments of signed rows (grp, x, w with w 1 for added and -1 for removed values)."""
    w, x = F.col("w"), F.col("x").cast("double")
    s = rows.groupBy("grp").agg(F.sum("w").alias("n"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"))
    n = F.col("n")
    mean = F.when(n > 0, F.col("s1") / n).otherwise(0.0)
    return s.select("grp", "n", mean.alias("mean"), F.when(n > 1, F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1))).otherwise(0.0).alias("variance"))


def counted(rows: DataFrame) -> DataFrame:
    """grp, x, c, cum, n: the distinct values with their number, how many values are not greater, and how many there are.

    Rows are counted per value, with map-side combining, before any window sees them."""
    return ranked(rows.groupBy("grp", "x").agg(F.count("*").alias("c")), "x", "c")


def ranked(rows: DataFrame, by: str, weight: str) -> DataFrame:
    """rows with cum, the weight of the group's rows up to their own in the order of `by`, and n, that of all its rows.

    Groups are dealt to stretches of `by`, whose sums are carried over a row per stretch, so that a group of very many
    different values is no single task.  A null group is a group, and null values come first."""
    cells = ordered_cells(rows, by)
    before = Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("grp", "cell").agg(F.sum(weight).alias("own_"))
    sums = sums.select(F.col("grp").alias("grp_"), F.col("cell").alias("cell_"), F.coalesce(F.sum("own_").over(before), F.lit(0)).alias("before_"), F.sum("own_").over(Window.partitionBy("grp")).alias("n"))
    within = Window.partitionBy("grp", "cell").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    own = cells.withColumn("cum", F.sum(weight).over(within)).join(sums, F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("cell") == F.col("cell_")))
    return own.select(*rows.columns, (F.col("cum") + F.col("before_")).alias("cum"), "n")


def _at(rank: str) -> Column:
    """The value of a 0-based rank, among the rows of counted()."""
    return F.min(F.when(F.expr(f"cum > {rank}"), F.col("x")))


def trimmed(rows: DataFrame) -> DataFrame:
    """grp, n, mean, deviation of the values within five times the larger third-to-median distance of the median."""
    values = counted(rows)
    q = values.groupBy("grp").agg(_at("n div 2").alias("med"), _at("n div 3").alias("lo"), _at("2 * n div 3").alias("hi"))
    near = 5 * F.greatest(F.col("med") - F.col("lo"), F.col("hi") - F.col("med"))
    good = values.join(q, "grp").filter((F.col("x") >= F.col("med") - near) & (F.col("x") <= F.col("med") + near))
    x, c, n, mean = F.col("x").cast("double"), F.col("c"), F.col("n"), F.col("mean")
    means = good.groupBy("grp").agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"))
    spread = good.select("grp", "x", "c").join(means, "grp").groupBy("grp", "n", "mean").agg(F.sum(c * (x - mean) * (x - mean)).alias("s"))
    return spread.select("grp", "n", "mean", F.when(n > 1, F.sqrt(F.col("s") / (n - 1))).otherwise(0.0).alias("deviation"))


def mode(rows: DataFrame) -> DataFrame:
    """grp, mode: the most frequent value, the smallest of several."""
    each = rows.groupBy("grp", "x").agg(F.count("*").alias("c"))
    return each.groupBy("grp").agg(F.max(F.struct("c", (-F.col("x")).alias("neg"), F.col("x").alias("v")))["v"].alias("mode"))


def median(rows: DataFrame) -> DataFrame:
    """grp, median: the mean of the two middle values, of whole numbers rounded toward zero; null values don't count."""
    halve = "(a + b) div 2" if dict(rows.dtypes)["x"] in ("tinyint", "smallint", "int", "bigint") else "(a + b) / 2"
    return counted(rows.filter("x is not null")).groupBy("grp").agg(_at("n div 2").alias("a"), _at("(n - 1) div 2").alias("b")).select("grp", F.expr(halve).alias("median"))


def mad(rows: DataFrame) -> DataFrame:
    """grp, mad: the upper median of the distances from the median; null values don't count."""
    values = rows.filter("x is not null").groupBy("grp", "x").agg(F.count("*").alias("c"))
    apart = values.join(median(rows), "grp").groupBy("grp", F.abs(F.col("x") - F.col("median")).alias("x")).agg(F.sum("c").alias("c"))
    return ranked(apart, "x", "c").groupBy("grp").agg(_at("n div 2").alias("mad"))


def moving(rows: DataFrame, alpha: float) -> DataFrame:
    """grp, ema: exponential moving average of x in the order of t (no ties); the weight of a value follows from how many come
    after it.

    Groups are dealt to stretches of t: a stretch sums its values as if nothing came
    after it, and its sum is weighted by how many rows the later stretches have."""
    cells = ordered_cells(rows, "t")
    w = Window.partitionBy("grp", "cell").orderBy(F.desc("t"))
    late = cells.withColumns({"late": F.row_number().over(w) - 1, "first": F.row_number().over(Window.partitionBy("grp", "cell").orderBy("t")) == 1})
    keep = 1 - alpha
    parts = late.groupBy("grp", "cell").agg(F.count("*").alias("m"), F.sum(F.pow(F.lit(keep), F.col("late")) * alpha * F.col("x")).alias("s"), F.max(F.when(F.col("first"), F.pow(F.lit(keep), F.col("late")) * (1 - alpha) * F.col("x"))).alias("lead"))
    behind = F.coalesce(F.sum("m").over(Window.partitionBy("grp").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.col("cell") == F.min("cell").over(Window.partitionBy("grp"))
    parts = parts.withColumns({"share": F.pow(F.lit(keep), behind), "whole": F.col("s") + F.when(begins, F.col("lead")).otherwise(0.0)})
    return parts.groupBy("grp").agg(F.sum(F.col("share") * F.col("whole")).alias("ema"))


#: Rows of a stretch, at most about so many: their number grows with the rows.
STRETCH = 1 << 20


def stretches(total: int, partitions: int) -> int:
    """Into how many stretches so many rows are dealt: as many as tasks work on them, and more of them if they would be long."""
    return max(partitions, -(-total // STRETCH))


def ordered_cells(rows: DataFrame, by: str, total: int = 0) -> DataFrame:
    """rows with cell, which within a group grows with `by`: the partitions of a range partitioning by both, whose bounds a
    sample gives, written once so that all that follows sees the same ones.  A group of a third of all rows is in a third
    of the cells; rows of one group and one value of `by` stay together.  What rows come from is read once: they are counted,
    sampled and dealt from a table of their own.  `total` says of how many rows they are made, where these are shuffled for it."""
    with shuffled_for(rows.sparkSession, total):
        rows = materialise(rows)
    n = stretches(rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(rows.repartitionByRange(n, "grp", by).withColumn("cell", F.spark_partition_id()))


def apart(cells: DataFrame) -> DataFrame:
    """Rows of ordered_cells with those of a cell of a group in one task, for windows and sums within (grp, cell): over as many
    tasks as there are stretches, so that what a task holds and sorts doesn't grow with the rows."""
    return cells.repartition(tasks_of(cells), "grp", "cell")


def tasks_of(cells: DataFrame) -> int:
    """How many tasks share the rows of ordered_cells: one for each file that was written."""
    return max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(cells.inputFiles()))


@contextmanager
def shuffled_for(spark: SparkSession, total: int) -> Iterator[None]:
    """What is run within is shuffled over as many tasks as so many rows need."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, stretches(total, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def weighted(hist: DataFrame) -> DataFrame:
    """grp, n, mean, deviation, mode, median, mad of rows (grp, value, weight); the median is the first value that reaches
    half, and mad that of the distances from it."""
    v, c, n = F.col("value"), F.col("weight"), F.col("n")
    hist = hist.select("grp", "value", "weight")
    middle = lambda x: F.min(F.when(F.expr("cum >= n div 2"), F.col(x)))
    own = ranked(hist, "value", "weight").groupBy("grp").agg(F.max("n").alias("n"), (F.sum(v * c) / F.max("n")).alias("mean"), F.max(F.struct("weight", (-v).alias("m")))["m"].alias("neg"), middle("value").alias("median"))
    apart = hist.join(own, "grp")
    spread = apart.groupBy("grp").agg(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))).alias("s"))
    far = apart.groupBy("grp", F.abs(v - F.col("median")).alias("far")).agg(F.sum("weight").alias("weight"))
    mads = ranked(far, "far", "weight").groupBy("grp").agg(middle("far").alias("mad"))
    return own.join(spread, "grp").join(mads, "grp").select("grp", "n", "mean", F.when(n > 1, F.sqrt(F.col("s") / (n - 1))).otherwise(0.0).alias("deviation"), (-F.col("neg")).alias("mode"), "median", "mad")


def sampled(hist: DataFrame, shares: list[float]) -> DataFrame:
    """grp, share, value: the inverse cumulative distribution of rows (grp, value, weight) at floor(share * n)."""
    rows = ranked(hist.select("grp", "value", "weight"), "value", "weight")
    at = rows.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return at.groupBy("grp", "share").agg(F.coalesce(F.min(F.when(F.col("cum") > F.floor(F.col("share") * F.col("n")), F.col("value"))), F.max("value")).alias("value"))


def distinct_sets(rows: DataFrame) -> DataFrame:
    """id, members, first_id of rows (id, words): equal sets of words share the smallest id."""
    sets = rows.select("id", F.array_sort(F.array_distinct("words")).alias("members"))
    firsts = sets.groupBy("members").agg(F.min("id").alias("first_id"))
    return sets.join(firsts, "members").select("id", "members", "first_id")


def fisher(rows: DataFrame) -> DataFrame:
    """rows of a two-by-two table (n11, n12, n21, n22) with lower, upper and two: exact tail probabilities, from as many numbers as there are tables with its sums."""
    @F.pandas_udf("struct<lower:double,upper:double,two:double>")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = []
        for n11, n12, n21, n22 in zip(a, b, c, d, strict=True):
            row, col, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
            lo, hi = max(0, row + col - n), min(row, col)
            k = np.arange(lo, hi)  # each table's chance from that of the one before
            steps = np.log(row - k) + np.log(col - k) - np.log(k + 1) - np.log(n - row - col + k + 1)
            p = np.append(0.0, np.cumsum(steps))
            p = np.exp(p - p.max())
            p /= p.sum()
            own = p[n11 - lo]
            out.append((p[: n11 - lo + 1].sum(), p[n11 - lo :].sum(), min(1.0, p[p <= own * (1 + 1e-9)].sum())))
        return pd.DataFrame(out, columns=["lower", "upper", "two"])

    return rows.withColumn("p", test("n11", "n12", "n21", "n22")).select(*rows.columns, "p.*")
