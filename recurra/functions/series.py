"""Series distances that built-in functions can't express; Arrow batches, each worked off as a whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def standard(x: np.ndarray) -> np.ndarray:
    """Rows without mean and with unit deviation."""
    return (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-10)


def warping_cost(s: np.ndarray, t: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Of each row of s and t; infinite where every path costs more than the row's limit."""
    (rows, n), m = s.shape, t.shape[1]
    out, left = np.full(rows, np.inf), np.arange(rows)
    # Along anti-diagonals every cell depends on the two before only.
    two, before = np.full((rows, n + 1), np.inf), np.full((rows, n + 1), np.inf)
    two[:, 0] = 0.0
    for d in range(2, n + m + 1):
        now = np.full((rows, n + 1), np.inf)
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        cost = (s[:, i - 1] - t[:, d - i - 1]) ** 2
        now[:, i] = cost + np.minimum(np.minimum(before[:, i - 1], before[:, i]), two[:, i - 1])
        two, before = before, now
        if limit is not None and not d % 8:
            # A path has a cell on one of any two diagonals in a row.
            open_ = np.minimum(two.min(1), before.min(1)) <= limit
            if not open_.all():
                s, t, two, before, limit, left = (x[open_] for x in (s, t, two, before, limit, left))
                rows = len(left)
    out[left] = before[:, n]
    return out


def warping_cost_of_one(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The same of one series with each column of t, whose columns are from last to first; cells of a diagonal are next to each other."""
    n, (m, columns) = len(s), t.shape
    two, before, now = (np.full((n + 1, columns), np.inf) for _ in range(3))
    two[0], spare, s = 0.0, np.empty((n, columns)), s[:, None]
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1)
        size, at = high - low + 1, m - (d - low)
        cost, here = spare[:size], now[low : high + 1]
        np.subtract(s[low - 1 : high], t[at : at + size], out=cost)
        np.multiply(cost, cost, out=cost)
        np.minimum(before[low - 1 : high], before[low : high + 1], out=here)
        np.minimum(here, two[low - 1 : high], out=here)
        np.add(here, cost, out=here)
        now[low - 1] = np.inf
        now[high + 1 : high + 2] = np.inf
        two, before, now = before, now, two
    return before[n].copy()


def warped_likeness(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of each row of s and t: exp of the root of the warping cost over the longer length; 0 for an empty side."""
    if not s.shape[1] or not t.shape[1]:
        return np.zeros(len(s))
    return np.exp(-np.sqrt(warping_cost(standard(s), standard(t))) / max(s.shape[1], t.shape[1]))


def likeness_above(s: np.ndarray, t: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """The same of rows that are standardised already; NaN where it is under the row's bar."""
    longest = max(s.shape[1], t.shape[1])
    if not s.shape[1] or not t.shape[1]:
        return np.where(bar <= 0, 0.0, np.nan)
    limit = np.full(len(s), np.inf)
    limit[bar > 0] = (np.log(bar[bar > 0]) * longest) ** 2
    cost = warping_cost(s, t, limit)
    return np.where(cost <= limit, np.exp(-np.sqrt(cost) / longest), np.nan)


def best_lag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and b: the largest normalised cross-correlation over all lags, within 0 and 1."""
    if not a.shape[1] or not b.shape[1]:
        return np.zeros(len(a))
    a, b = standard(a), standard(b)
    size = a.shape[1] + b.shape[1] - 1
    product = np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size))
    most = np.fft.irfft(product, size).max(1)
    return np.clip(most / (np.sqrt((a * a).sum(1) * (b * b).sum(1)) + 1e-10), 0.0, 1.0)


def batched(rule, a: pd.Series, b: pd.Series, *more: pd.Series, rows: int = 4096) -> pd.Series:
    """The rule over all pairs of equal lengths at once; null where a side is null.  More columns are numbers of the pairs."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    lengths = [(len(a.iloc[i]), len(b.iloc[i])) for i in known]
    for pair in set(lengths):
        own = np.array([i for i, p in zip(known, lengths) if p == pair])
        for few in np.split(own, range(rows, len(own), rows)):
            x, y = (np.array([np.asarray(v.iloc[i], float) for i in few]).reshape(len(few), n) for v, n in zip((a, b), pair))
            out[few] = rule(x, y, *(v.to_numpy(float)[few] for v in more))
    return pd.Series(out).where(~np.isnan(out), None).astype("Float64")


def pairwise(rule):
    """A Pandas UDF of two array columns; made on the driver when it is used."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return batched(rule, a, b)

    return pandas_udf(run, "double")


def dtw(a: Column, b: Column) -> Column:
    return pairwise(warped_likeness)(a, b)


def dtw_above(a: Column, b: Column, bar: Column) -> Column:
    """dtw of standardised arrays; null where it is under the bar."""

    def run(a: pd.Series, b: pd.Series, bar: pd.Series) -> pd.Series:
        return batched(likeness_above, a, b, bar)

    return pandas_udf(run, "double")(a, b, bar)


def xcorr(a: Column, b: Column) -> Column:
    return pairwise(best_lag)(a, b)
