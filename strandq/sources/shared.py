"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folders made so far, by application.
_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir.  Where that is unset, a folder of this machine will do for a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandq-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/strandq-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The scratch folders of this application that weren't removed, oldest first."""
    return _MADE.setdefault(spark.sparkContext.applicationId, [])


def remove(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch folders (all of this application's by default), once nothing that reads them is of use any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(made(spark) if paths is None else paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        made(spark).remove(path)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back; it outlives any executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
