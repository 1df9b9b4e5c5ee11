"""Mersenne-twister streams as Columns: one stream per row, from the row's own seed, so that any task gives the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def twister(seed: Column, n: int) -> Column:
    """The first n 32-bit outputs of the generator for a seed (its low 32 bits); null for a null seed."""

    @F.pandas_udf("array<long>")
    def run(seeds: pd.Series) -> pd.Series:
        one = lambda s: None if pd.isna(s) else np.random.RandomState(int(s) & 0xFFFFFFFF).randint(0, 1 << 32, n, dtype=np.uint32).astype(np.int64)
        return pd.Series([one(s) for s in seeds], dtype=object)

    return run(seed.cast("long"))


def wide(outputs: Column, i: int) -> Column:
    """The i-th 64-bit output: two of 32 bits, the first above, as a signed number."""
    return F.shiftleft(F.get(outputs, F.lit(2 * i)), 32).bitwiseOR(F.get(outputs, F.lit(2 * i + 1)))


def real_closed(y: Column) -> Column:
    """In [0, 1]."""
    return y / float((1 << 32) - 1)


def real_half_open(y: Column) -> Column:
    """In [0, 1)."""
    return y / float(1 << 32)


def real_open(y: Column) -> Column:
    """In (0, 1)."""
    return (y + 0.5) / float(1 << 32)


def real_53(high: Column, low: Column) -> Column:
    """In [0, 1) with 53 bits, of two outputs."""
    return (F.shiftright(high, 5) * float(1 << 26) + F.shiftright(low, 6)) / float(1 << 53)


def exponential(y: Column, mode: float, rate: float) -> Column:
    return F.lit(mode) - F.log(real_open(y)) / rate


def gaussian(outputs: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """Polar method: the first pair of outputs inside the unit circle counts; null if an array holds none.
    outputs must be a column selected before, not the call of twister itself."""
    side = lambda i: 2 * real_closed(F.get(outputs, i)) - 1
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(outputs) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(side(i).alias("x"), side(i + 1).alias("y")))
    sized = F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), (p["x"] * p["x"] + p["y"] * p["y"]).alias("w")))
    first = F.get(F.filter(sized, lambda p: (p["w"] < 1) & (p["w"] > 0)), F.lit(0))
    return F.lit(mean) + first["x"] * F.sqrt(-2 * F.log(first["w"]) / first["w"]) * deviation
