"""What an executor holds when the pipeline's stages run on it one after the other."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandq.llm import common


@pytest.fixture
def unset(spark):
    before = spark.conf.get(common.BATCH_BYTES)
    spark.conf.unset(common.BATCH_BYTES)
    yield
    spark.conf.set(common.BATCH_BYTES, before)


def largest(docs):
    """Bytes of text that Python gets at once by each of the three ways that stages hand it rows."""

    def arrow(rows):
        for b in rows:
            yield pa.record_batch({"n": pa.array([sum(len(x) for x in b.column(0).to_pylist())], pa.int64())})

    def frames(parts):
        for p in parts:
            yield pd.DataFrame({"n": [int(p["text"].str.len().sum())]})

    @F.pandas_udf("long")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    ways = docs.mapInArrow(arrow, "n long"), docs.mapInPandas(frames, "n long"), docs.select(column("text").alias("n"))
    return [w.agg(F.max("n")).first()[0] for w in ways]


def test_stages_hand_python_small_batches(spark, unset, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(0, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2048).alias("text"))
    few = spark.createDataFrame([(0, "some words")], "doc_id long, text string")
    for name, stage in pipeline.STAGES:
        spark.conf.unset(common.BATCH_BYTES)
        assert min(largest(docs)) > 6_000_000
        stage(spark, few, str(tmp_path))
        assert max(largest(docs)) < 1_100_000, name


def test_a_bound_of_the_session_stays(spark, unset):
    spark.conf.set(common.BATCH_BYTES, "2m")
    common.small_batches(spark)
    assert spark.conf.get(common.BATCH_BYTES) == "2m"
