"""Every vector of one table with every one of another, a tile at a time: products of matrices, then exact sums where they count.

A tile has rows of both tables as Arrow tables.  Products round in an order of their own, so they only bound a score;
what is kept is worked out again in the order of the numbers, as a loop over them (or SQL) does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..config import EPS
from . import series

#: Cells of a tile that are worked on together, and pairs that are worked out again together.
CELLS, PAIRS = 1 << 20, 1 << 15
#: A product of n numbers is off by no more than n times this share of the norms (fixed value: a bit over the unit of doubles).
UNIT = 2.0**-50


def whole(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows that have a vector of so many numbers, none of them null, and the vectors."""
    lists = whole(column)
    starts = lists.offsets.to_numpy()
    nulls = np.append(0, np.cumsum(pc.is_null(lists.values).to_numpy(zero_copy_only=False)))
    known = pc.is_valid(lists).to_numpy(zero_copy_only=False) & (nulls[starts[1:]] == nulls[starts[:-1]])
    values, sizes = lists.values.to_numpy(zero_copy_only=False).astype(float), np.diff(starts)
    rows = {int(n): np.flatnonzero(known & (sizes == n)) for n in np.unique(sizes[known])}
    return {n: (own, values[starts[own][:, None] + np.arange(n)].reshape(len(own), n)) for n, own in rows.items()}


def numbers_of(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The columns' values as numbers, equal ones for equal values; -1 for null."""
    parts = [whole(c) for c in columns]
    codes = pa.concat_arrays([p.cast(parts[0].type) for p in parts]).dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.split(codes, np.cumsum([len(p) for p in parts])[:-1])


def equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i] = b[j], in order of i."""
    order = np.argsort(b, kind="stable")
    first, end = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    times = end - first
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(np.arange(len(a)), times), order[np.repeat(first, times) + step]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of columns, summed from the first row to the last."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        total += x * y
    return total


class Side:
    """Vectors of one length: columns, squares in order, norms and what norms are divided by."""

    def __init__(self, x: np.ndarray):
        self.x, self.t = x, np.ascontiguousarray(x.T)
        self.square = in_order(self.t, self.t)
        self.flat = np.sqrt(self.square) < EPS
        with np.errstate(divide="ignore"):
            self.inverse = np.where(self.flat, 0.0, 1 / np.sqrt(self.square))

    def shaped(self) -> Side:
        """Their standardised forms, for correlations."""
        return Side(series.standard(self.x)) if self.x.shape[1] else self


def scale(n: int) -> float:
    return np.sqrt(float(n)) + EPS


def cosine(dot: np.ndarray, a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    found = np.clip(dot / np.sqrt(a.square[i] * b.square[j]), -1.0, 1.0)
    return np.where(a.flat[i] | b.flat[j], 0.0, found)


def exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and euclidean likeness of the pairs."""
    x, y = a.t[:, i], b.t[:, j]
    gap = x - y
    return cosine(in_order(x, y), a, b, i, j), np.exp(-np.sqrt(in_order(gap, gap)) / scale(len(x)))


def near(a: Side, b: Side, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(product, distance, its error) of every vector of b with some of a."""
    n = a.x.shape[1]
    product = a.x[at] @ b.t
    both = a.square[at][:, None] + b.square
    error = both * (UNIT * 4 * (n + 8))
    distance = np.sqrt(np.maximum(both - 2 * product, error))
    with np.errstate(divide="ignore", invalid="ignore"):
        error = np.where(distance > 0, error / distance, 0.0)
    return product, distance, error


def correlation(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The largest normalised cross-correlation over all lags, within 0 and 1, of the pairs of two shaped sides."""
    out, n = np.zeros(len(i)), a.x.shape[1]
    if n:
        size = 1 << (2 * n - 1).bit_length()  # lags beyond the ends are zeros, which the bounds hide
        p, q = np.fft.rfft(a.x, size), np.conj(np.fft.rfft(b.x, size))
        for k in range(0, len(i), PAIRS >> 3):
            at = slice(k, k + (PAIRS >> 3))
            out[at] = np.fft.irfft(p[i[at]] * q[j[at]], size).max(1)
        out = np.clip(out / (np.sqrt(a.square[i] * b.square[j]) + 1e-10), 0.0, 1.0)
    return out


def reaching(i: np.ndarray, low: np.ndarray, high: np.ndarray, top_n: int) -> np.ndarray:
    """Which pairs can be among the best top_n of their i, whose values are sorted."""
    low = np.where(np.isfinite(low), low, -np.inf)
    order = np.lexsort((-low, i))
    last = np.searchsorted(i, i) + top_n - 1
    within = last < np.searchsorted(i, i, "right")
    bar = np.where(within, low[order][np.minimum(last, len(i) - 1)], -np.inf)
    return ~(high < bar)


def best(a: Side, b: Side, weights: tuple[float, float, float], threshold: float, top_n: int, place: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, cosine, euclidean, correlation, composite) of each query's best top_n, ties by place; without the pairs `own`.

    Products bound every composite from both sides.  A query's bar is the top_n-th best of what is sure; only pairs
    that can reach it are worked out.
    """
    (c, e, x), n = weights, a.x.shape[1]
    tiny = UNIT * 8 * (n + 8)
    sa, sb = (a.shaped(), b.shaped()) if x else (None, None)
    rows = max(1, CELLS // max(1, len(b.x)))
    for k in range(0, len(a.x), rows):
        at = slice(k, min(k + rows, len(a.x)))
        product, distance, error = near(a, b, at)
        distance /= scale(n)
        middle = e * np.exp(-distance) + c * (product * a.inverse[at][:, None] * b.inverse)
        error *= abs(e) / scale(n)
        error += tiny * (abs(c) + abs(x) + abs(e))
        low, high = middle - error, middle + error
        if x:
            at_once = sa.x[at] @ sb.t / (np.sqrt(sa.square[at][:, None] * sb.square) + 1e-10)
            low += min(x, 0.0) + max(x, 0.0) * np.clip(at_once, 0.0, 1.0)
            high += max(x, 0.0)
        mine = (own[0] >= at.start) & (own[0] < at.stop)
        skip = (own[0][mine] - k, own[1][mine])
        low[skip], high[skip] = -np.inf, -np.inf
        bar = np.full(at.stop - k, float(threshold) - tiny)
        if len(b.x) > top_n:
            low[~np.isfinite(low)] = -np.inf
            bar = np.maximum(bar, np.partition(low, -top_n, axis=1)[:, -top_n])
        i, j = np.nonzero(~(high < bar[:, None]))
        middle, error, i = middle[i, j], error[i, j], i + k
        cross = np.zeros(len(i))
        if x:
            # Now that correlations are known, few can still be among the best.
            cross = correlation(sa, sb, i, j)
            keep = reaching(i, middle + x * cross - error, middle + x * cross + error, top_n)
            i, j, cross = i[keep], j[keep], cross[keep]
        parts = [exact(a, b, i[s : s + PAIRS], j[s : s + PAIRS]) for s in range(0, len(i), PAIRS)]
        cos, euc = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0), np.zeros(0))
        score = c * cos + e * euc + x * cross if x else c * cos + e * euc
        keep = ~(score < threshold)
        i, j, cos, euc, cross, score = (v[keep] for v in (i, j, cos, euc, cross, score))
        order = np.lexsort((place[j], -np.where(np.isnan(score), np.inf, score), i))
        heads = np.searchsorted(i[order], i[order])
        order = order[np.arange(len(order)) - heads < top_n]
        yield tuple(v[order] for v in (i, j, cos, euc, cross, score))


def likenesses(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and euclidean likeness of every pair; near ones, whose distance a product blurs, are worked out in order."""
    product, distance, _ = near(a, b, slice(None))
    both = np.sqrt(a.square[:, None] * b.square)
    cos = np.where(a.flat[:, None] | b.flat, 0.0, np.clip(product / both, -1.0, 1.0))
    euc = np.exp(-distance / scale(a.x.shape[1]))
    i, j = np.nonzero(~(distance * distance >= 0.05 * (a.square[:, None] + b.square)))
    for s in range(0, len(i), PAIRS):
        at = i[s : s + PAIRS], j[s : s + PAIRS]
        cos[at], euc[at] = exact(a, b, *at)
    return cos, euc


def correlations(a: Side, b: Side) -> tuple[np.ndarray]:
    """The largest normalised cross-correlation of every pair, a product of matrices for each lag."""
    n, m = a.x.shape[1], b.x.shape[1]
    out = np.zeros((len(a.x), len(b.x)))
    if not n or not m:
        return (out,)
    a, b = a.shaped(), b.shaped()
    rows = max(1, (CELLS >> 3) // max(1, len(b.x)))
    for k in range(0, len(a.x), rows):
        x, most = a.x[k : k + rows], out[k : k + rows]
        made = np.empty_like(most)
        most[:] = -np.inf
        for lag in range(1 - m, n):
            low, high = max(0, lag), min(n, m + lag)
            np.matmul(x[:, low:high], b.t[low - lag : high - lag], out=made)
            np.maximum(most, made, out=most)
    out /= np.sqrt(a.square[:, None] * b.square) + 1e-10
    return (np.clip(out, 0.0, 1.0, out=out),)


def warpings(a: Side, b: Side, columns: int = 512) -> tuple[np.ndarray]:
    """The likeness by time warping of every pair, one series of a with many of b at a time; 0 for an empty side."""
    n, m = a.x.shape[1], b.x.shape[1]
    out = np.zeros((len(a.x), len(b.x)))
    if not n or not m:
        return (out,)
    x, y = series.standard(a.x), series.standard(b.x)
    for k in range(0, len(y), columns):
        t = np.ascontiguousarray(y[k : k + columns].T[::-1])
        for i, s in enumerate(x):
            out[i, k : k + columns] = series.warping_cost_of_one(s, t)
    return (np.exp(-np.sqrt(out) / max(n, m)),)


def every(patterns: pa.Table, queries: pa.Table, rule: Callable[[Side, Side], tuple[np.ndarray, ...]], names: tuple[str, ...], schema: pa.Schema, but_itself: bool, mixed: bool) -> pa.Table:
    """A row for each pair with the rule's values; null where a vector is, and where lengths differ unless they may (mixed)."""
    m, n = queries.num_rows, patterns.num_rows
    if not m or not n:
        return schema.empty_table()
    values, known = [np.zeros((m, n)) for _ in names], np.zeros((m, n), bool)
    ours, theirs = matrices(queries.column("q_vector")), matrices(patterns.column("vector"))
    with np.errstate(all="ignore"):
        for size, other in ((s, t) for s in ours for t in theirs if mixed or s == t):
            (i, x), (j, y) = ours[size], theirs[other]
            made = rule(Side(x), Side(y))
            if len(i) == m and len(j) == n:
                values, known = list(made), np.ones((m, n), bool)
            else:
                for v, new in zip(values, made):
                    v[np.ix_(i, j)] = new
                known[np.ix_(i, j)] = True
    keep = np.ones((m, n), bool)
    if but_itself:
        a, b = numbers_of(queries.column("query_id"), patterns.column("pattern_id"))
        keep[a < 0], keep[:, b < 0] = False, False
        keep[equal_pairs(a, b)] = False
    at = np.flatnonzero(keep)
    i, j = np.divmod(at, n)
    full = known.all()
    columns = {"query_id": queries.column("query_id").take(pa.array(i)), "pattern_id": patterns.column("pattern_id").take(pa.array(j))}
    columns |= {c: pa.array(v.ravel()[at], mask=None if full else ~known.ravel()[at]) for c, v in zip(names, values)}
    return pa.table(columns).select(schema.names)


def searched(patterns: pa.Table, queries: pa.Table, weights: tuple[float, float, float], threshold: float, top_n: int, schema: pa.Schema, but_itself: bool) -> pa.Table:
    """The rows of both tables for each query's best top_n of this tile, with their scores; pairs without a score are left out."""
    ours, theirs = (matrices(t.column(c)) if t.num_rows else {} for t, c in ((queries, "q_vector"), (patterns, "vector")))
    found = []
    for size in ours.keys() & theirs.keys():
        (i, x), (j, y) = ours[size], theirs[size]
        place = np.empty(patterns.num_rows, np.int64)
        place[pc.sort_indices(whole(patterns.column("pattern_id")), null_placement="at_start").to_numpy()] = np.arange(patterns.num_rows)
        own = (np.zeros(0, int), np.zeros(0, int))
        if but_itself:
            a, b = numbers_of(queries.column("query_id"), patterns.column("pattern_id"))
            i, x, j, y = i[a[i] >= 0], x[a[i] >= 0], j[b[j] >= 0], y[b[j] >= 0]
            own = equal_pairs(a[i], b[j])
        if len(i) and len(j):
            with np.errstate(all="ignore"):
                found += [(i[r[0]], j[r[1]], *r[2:]) for r in best(Side(x), Side(y), weights, threshold, top_n, place[j], own)]
    if not found:
        return schema.empty_table()
    i, j, *scores = (np.concatenate(p) for p in zip(*found))
    columns = {c: t.column(c).take(pa.array(at)) for t, at in ((patterns, j), (queries, i)) for c in t.column_names if c in schema.names}
    return pa.table(columns | dict(zip(("cosine", "euclidean", "dtw", "composite"), map(pa.array, scores)))).select(schema.names)
