"""Special functions as Columns: sums of their series, for a batch at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _series(first: np.ndarray, ratio) -> np.ndarray:
    """first * (1 + ratio(1) + ratio(1) ratio(2) + ...), until no term counts any more."""
    total = term = np.ones_like(first)
    n = 1
    while (term > total * 1e-17).any():
        term = term * ratio(n)
        total = total + term
        n += 1
    return first * total


def gamma_share(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of the gamma function of a > 0 that lies below x >= 0."""
    with np.errstate(divide="ignore"):
        first = np.where(x > 0, np.exp(a * np.log(x) - x - _log_gamma(a + 1)), 0.0)
    return np.minimum(_series(first, lambda n: x / (a + n)), 1.0)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of the beta function of a, b > 0 that lies below x, from 0 to 1; the side whose series is shorter is summed."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        log = p * np.log(y) + q * np.log1p(-y) + _log_gamma(p + q) - _log_gamma(p + 1) - _log_gamma(q)
    below = _series(np.where(y > 0, np.exp(log), 0.0), lambda n: y * (p + q + n - 1) / (p + n))
    return np.clip(np.where(swap, 1 - below, below), 0.0, 1.0)


def _column(f, *args: Column) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        known = np.logical_and.reduce([s.notna().to_numpy() for s in series])
        out = np.full(len(known), np.nan)
        out[known] = f(*(s.to_numpy(float)[known] for s in series))
        return pd.Series(out).where(known)

    return run(*(a.cast("double") for a in args))


def log_gamma(x: Column) -> Column:
    return _column(_log_gamma, x)


def erfc(x: Column) -> Column:
    """The complement of the error function."""
    return _column(np.vectorize(math.erfc, otypes=[float]), x)


def gamma_below(a: Column, x: Column) -> Column:
    return _column(gamma_share, a, x)


def beta_below(a: Column, b: Column, x: Column) -> Column:
    return _column(beta_share, a, b, x)
