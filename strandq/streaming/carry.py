"""Sequences that arrive in pieces, over micro-batches: what a piece needs of those before it is kept as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: The state store that named, expiring states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Sequences are dealt to so many keys of the state store.  It is called per key, not per sequence, and a key's state is that of
#: the open sequences dealt to it.  A stream must go on with the number that it began with.
KEYS = 1024


class _Carry(StatefulProcessor):
    """Per sequence of a key: the number of the next piece, where it begins, the last bases so far, when to forget it, and pieces
    that came too early.  All of a key are read and written at once."""

    def __init__(self, overlap: int, expire_s: float | None) -> None:
        self.overlap, self.expire = overlap, None if expire_s is None else int(expire_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "sequences string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, dict[int, tuple[str, bool]]] = {}
        touched: dict[int, int] = {}
        for part in rows:
            for i, c, p, last, at in zip(*(part[c].tolist() for c in ("seq_idx", "chunk", "piece", "is_last", "at")), strict=True):
                new.setdefault(i, {}).setdefault(c, (p or "", last))
                touched[i] = max(touched.get(i, 0), at)
        open_, out = self._read(), []
        for i, pieces in new.items():
            following, bgn, tail, wake, early = open_.pop(i, (0, 0, "", 0, {}))
            for c in pieces:
                if c > following:
                    early.setdefault(c, pieces[c])
            ended = False
            while not ended:
                if following in early:
                    piece, ended = early.pop(following)
                elif following in pieces:
                    piece, ended = pieces[following]
                else:
                    break
                out.append((i, following, bgn, tail, piece, ended))
                following, bgn = following + 1, bgn + len(piece)
                tail = (tail + piece)[-self.overlap :] if self.overlap else ""
            if not ended:
                if self.expire is not None:
                    wake = max(wake, max(touched[i], timerValues.getCurrentWatermarkInMs()) + self.expire)
                open_[i] = following, bgn, tail, wake, early
        self._write(open_)
        yield pd.DataFrame(out, columns=["seq_idx", "chunk", "bgn", "lead", "piece", "is_last"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._write({i: x for i, x in self._read().items() if x[3] > now})
        yield pd.DataFrame([], columns=["seq_idx", "chunk", "bgn", "lead", "piece", "is_last"])

    def _read(self) -> dict[int, tuple[int, int, str, int, dict[int, tuple[str, bool]]]]:
        held = self.state.get() if self.state.exists() else None
        return {i: (*x, {c: (p, last) for c, p, last in early}) for i, *x, early in json.loads(held[0])} if held else {}

    def _write(self, open_: dict) -> None:
        if open_:
            self.state.update((json.dumps([(i, *x, [(c, *y) for c, y in early.items()]) for i, (*x, early) in open_.items()], separators=(",", ":")),))
        else:
            self.state.clear()
        if self.expire is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if open_:
                self.handle.registerTimer(min(x[3] for x in open_.values()))

    def close(self) -> None:
        pass


def carried(chunks: DataFrame, overlap: int, expire_s: float | None = None) -> DataFrame:
    """seq_idx, chunk, bgn, lead, piece, is_last of a stream of rows (seq_idx, chunk, piece, is_last): each piece with where it
    begins in its sequence and the `overlap` bases before it, in the order of chunk, which counts from 0.

    Pieces that come before their turn are kept until it comes; of a piece that comes again the first counts, as long as its
    sequence hasn't ended, after which it would begin a new one.  With its last piece a sequence is forgotten.  With
    expire_s rows need a time (ts) under a watermark, and a sequence is forgotten that the watermark has left behind by so many
    seconds; without it, state stays until the last piece comes.  Null pieces are empty; rows without seq_idx or chunk
    are left out.  The sequences of a key (see KEYS) meet in one task, which holds their pieces of a batch and their state.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    time = [] if expire_s is None else ["ts"]
    at = F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)) if time else F.lit(0).cast("long")
    rows = chunks.filter("seq_idx is not null and chunk is not null").select(F.col("seq_idx").cast("long").alias("seq_idx"), F.col("chunk").cast("long").alias("chunk"), "piece", F.coalesce("is_last", F.lit(False)).alias("is_last"), at.alias("at"), *time)
    schema = "seq_idx long, chunk long, bgn long, lead string, piece string, is_last boolean"
    return rows.withColumn("key", F.pmod(F.xxhash64("seq_idx"), F.lit(KEYS))).groupBy("key").transformWithStateInPandas(_Carry(overlap, expire_s), outputStructType=schema, outputMode="Append", timeMode="EventTime" if time else "None")


def squeezed(chunks: DataFrame, expire_s: float | None = None) -> DataFrame:
    """seq_idx, chunk, piece: pieces with runs of a letter squeezed, a run that goes on from the piece before left out; letters
    compare without case.  The pieces of a sequence, joined, are the squeezed sequence."""
    from ..functions import bases as B

    led = carried(chunks, 1, expire_s)
    whole = B.runs_squeezed(F.concat("lead", "piece"))
    return led.select("seq_idx", "chunk", F.substring(whole, F.length("lead") + 1, F.length(whole)).alias("piece"))
