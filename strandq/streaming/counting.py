"""Incremental k-mer counts and running statistics over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers
from ..sources import shared
from . import carry


def count_stream(spark: SparkSession, reads: DataFrame, k: int, out: str, state: str) -> DataFrame:
    """Counts of a stream of reads (seq_idx, bases): each micro-batch writes its partial counts as a batch, and merging
    the batches gives the table.  `out` and `state` must lie in a folder that all executors share."""

    def save(part: DataFrame, batch: int) -> None:
        kmers.count(part, k).withColumns({"batch": F.lit(batch).cast("long"), "label": F.lit(batch).cast("long")}).write.mode("overwrite").parquet(f"{out}/b={batch}")

    reads.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return kmers.merge(spark.read.schema("kmer string, value long, batch long, label long").option("recursiveFileLookup", "true").parquet(out))


def count_chunks(spark: SparkSession, chunks: DataFrame, k: int, out: str, state: str, expire_s: float | None = None) -> DataFrame:
    """Counts of the k-mers of sequences that come in pieces (see carry.carried), across batches and restarts."""
    led = carry.carried(chunks, k - 1, expire_s).select("seq_idx", F.concat("lead", "piece").alias("bases"))
    return count_stream(spark, led, k, out, state)


def sliding_stats(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """Count, mean and deviation of value per sliding window of ts and kind; works on batches and on streams."""
    if events.isStreaming:  # watermarks need points in time, not local times
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("deviation"))


def latest(spark: SparkSession, out: str, state: str, table: DataFrame) -> DataFrame:
    """The whole table of a streaming aggregation after what is there now: each batch writes it anew, and the last one written
    to its end counts, in this run or an earlier one.  Before any batch the table is empty."""

    def save(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{out}/b={batch}")

    table.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    written = [int(name[2:]) for name in shared.listed(spark, out) if name.startswith("b=") and "_SUCCESS" in shared.listed(spark, f"{out}/{name}")]
    if not written:
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).parquet(f"{out}/b={max(written)}")
