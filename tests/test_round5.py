"""Work that must not grow faster than its rows: state per key, spread tasks, packed counts, headers parsed once."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandq.functions import text
from strandq.llm import gif
from strandq.operators import headers, kmers
from strandq.streaming import carry

PIECES = "seq_idx long, chunk long, piece string, is_last boolean, ts timestamp"


def test_the_state_store_is_called_per_key_and_sequences_of_a_key_are_forgotten_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(carry, "KEYS", 2, raising=False)
    base = f"file://{tmp_path}"

    def put(rows, s):
        spark.createDataFrame([(*x, None) for x in rows], PIECES).withColumn("ts", F.timestamp_seconds(F.lit(s))).coalesce(1).write.mode("append").parquet(f"{base}/in")

    put([(i, 0, "ACGT", False) for i in range(40)], 2000)
    put([(99, 0, "C", True)] + [(i, 2, "late", True) for i in range(30, 40)], 9000)
    put([(98, 0, "C", True)], 9001)
    put([(i, 0, "TT", False) for i in range(20)], 9002)
    put([(i, 1, "G", True) for i in range(20)] + [(i, 1, "A", False) for i in range(30, 40)], 9003)
    stream = spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withWatermark("ts", "1 second")
    q = carry.carried(stream, 4, expire_s=60).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(x["stateOperators"][0]["numRowsTotal"] for x in q.recentProgress if x["stateOperators"]) < 20
    got = Counter((x.chunk, x.lead, x.piece) for x in spark.read.parquet(f"{base}/out").collect())
    assert got == {(0, "", "ACGT"): 40, (0, "", "C"): 2, (0, "", "TT"): 20, (1, "TT", "G"): 20, (1, "ACGT", "A"): 10, (2, "CGTA", "late"): 10}


def test_a_longest_match_evaluates_its_text_once(spark):
    plan = spark.range(1).select(text.longest_match(F.md5(F.col("id").cast("string")), "([0-9a-f]{,3}[a-f]|({c}[0-9])[a-f])*")[1].alias("x"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    some = [("",), (None,), ("x",), ("a",), ("ab",), ("ababx",), ("xab",), ("aab",), ("a\nb",)]
    got = spark.createDataFrame(some, "s string").select(text.longest_match(F.col("s"), "({c}a|ab|abab)*"))
    assert [x[0] for x in got.collect()] == [None, None, None, ["a", "a"], ["ab", "ab"], ["abab", "ab"], None, ["aab", "ab"], ["a", "a"]]


def test_headers_are_taken_apart_once(spark):
    lines = spark.createDataFrame([(s, n, f'##INFO=<ID=a{n % 3},Number={s % 2},Type=Integer,Description="x">') for s in range(3) for n in range(6)] + [(0, 9, "##made=one"), (1, 9, "##made=two")], "source long, nth long, line string")
    out = headers.merged(headers.parsed(lines))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.source, x.nth, x.id, x.value, x.differs) for x in out.collect()) == [(0, 0, "a0", None, True), (0, 1, "a1", None, True), (0, 2, "a2", None, True), (0, 9, None, "one", False)]


def some_reads():
    r = random.Random(9)
    short = ["".join(r.choice("ACGTacgtN") if r.random() < 0.9 else r.choice("é中\n- ") for _ in range(r.choice((0, 1, 4, 5, 40, 90)))) for _ in range(300)]
    return [*short, *short[:40], None, "ACGT" * 30, "A" * 200, "".join(r.choice("ACGT") for _ in range(3000))]


def plain(texts, k):
    """seq_idx, pos, k-mer of every window, one by one."""
    key = lambda x: x.translate(str.maketrans("ACTG", "0123"))
    for i, t in enumerate(texts):
        t = (t or "").translate(str.maketrans("acgt", "ACGT"))
        for p in range(len(t) - k + 1):
            f = t[p : p + k]
            if not set(f) - set("ACGT"):
                yield i, p, min(f, f[::-1].translate(str.maketrans("ACGT", "TGCA")), key=key)


@pytest.mark.parametrize("k", [1, 5, 21, 31, 32, 33, 50, 64])
def test_kmers_counted_in_packed_rows_are_those_counted_one_by_one(spark, monkeypatch, k):
    texts = some_reads()
    own = Counter(x for _, _, x in plain(texts, k))
    reads = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, bases string").repartition(3)
    for least in (1, 2):
        assert {x.kmer: x.value for x in kmers.count(reads, k, least=least).collect()} == {x: n for x, n in own.items() if n >= least}


def test_a_block_of_kmers_is_shuffled_in_a_row_per_cell():
    words = [np.random.default_rng(1).integers(0, 1 << 42, 200_000, np.uint64)]
    packed = kmers._celled(*kmers._added(kmers._mixed(words), np.ones(200_000, np.int64)))
    assert packed.num_rows <= 1 << kmers.CELL_BITS and packed.nbytes < 20 * 200_000
    back = [np.frombuffer(x, "<u8") for x in packed.column(1).to_pylist()]
    assert (np.sort(kmers._unmixed([np.concatenate(back)])[0]) == np.unique(words[0])).all()


@pytest.mark.parametrize("k", [5, 33, 64])
def test_windows_of_many_short_reads_are_taken_at_once(monkeypatch, k):
    texts = some_reads()
    ascii_ = [None if t is None else re.sub(r"[^\x00-\x7F]", "N", t) for t in texts]
    batch = pa.record_batch([pa.array([7 + i for i in range(len(texts))]), pa.array([t and t.encode() for t in ascii_], pa.binary())], ["seq_idx", "bases"])
    assert len(list(kmers._placed(batch, k))) == 1
    for block in (kmers.BLOCK, 100):
        monkeypatch.setattr(kmers, "BLOCK", block)
        got = pa.Table.from_batches(kmers._placed(batch, k)).to_pydict()
        hi = got.get("packed_hi", [0] * len(got["pos"]))
        number = [(h % (1 << 64)) << 64 | w % (1 << 64) for h, w in zip(hi, got["packed"], strict=True)]
        assert list(zip(got["seq_idx"], got["pos"], number, strict=True)) == [(7 + i, p, int(x.translate(str.maketrans("ACTG", "0123")), 4)) for i, p, x in plain(ascii_, k)]


def test_codes_of_a_stretch_leave_no_trace_in_the_next():
    r = random.Random(2)
    for depth in (2, 5, 8, 3, 8):
        data = bytes(r.randrange(1 << depth) for _ in range(9000))
        assert gif.lzw_decode(gif.lzw_encode(data, depth), depth, len(data)) == data
        assert not any(gif._TABLE)
    assert gif.lzw_codes(b"", 8).tolist() == [256, 257] and gif.lzw_codes(b"\0\0\0\0", 2).tolist() == [4, 0, 6, 0, 5]
