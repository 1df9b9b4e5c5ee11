"""Keys that too many rows have for one task: dealt to cells on one side of a join, copied to each cell on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: A key is dealt to cells if it has more than LEAST rows, and more than a task's share divided by SHARE.
LEAST, SHARE = 512, 8


def heavy(rows: DataFrame, keys: list[str], total: int, least: int | None = None) -> DataFrame:
    """keys, cells of the keys that too many of the `total` rows have for one task, and into how many cells to deal them.

    There are at most SHARE times as many as shuffle partitions, which bounds the broadcast.
    """
    return heavy_of(rows.groupBy(*keys).agg(F.count("*").alias("rows_")), keys, total, least, "rows_")


def heavy_of(counts: DataFrame, keys: list[str], total: int, least: int | None = None, n: str = "n") -> DataFrame:
    """The same from counts (keys, n)."""
    cell = max(LEAST if least is None else least, total // (SHARE * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return F.broadcast(materialise(counts.filter(F.col(n) > cell).select(*keys, F.ceil(F.col(n) / cell).cast("int").alias("cells"))))


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """rows with the cell of their key that a hash of `by` gives."""
    return rows.join(hot, keys, "left").withColumn("cell", F.pmod(F.xxhash64(*by), F.coalesce("cells", F.lit(1))).cast("int")).drop("cells")


def copied(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for each cell of their key."""
    return rows.join(hot, keys, "left").withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))).drop("cells")
