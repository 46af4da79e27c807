"""The best patterns of each query by time warping, without warping most pairs.

Two bounds of the warping cost come from built-in functions: the diagonal is a path, so it costs no less than the
best one; every inner point is matched with something between the other side's extremes, and first and last points
are matched with each other, so no path costs less than that.  A query's bar is the top_n-th best of what the diagonals
guarantee; pairs whose other bound is under the bar are not warped, and warping stops where every path is too dear.

Null series are left out; an empty one has a likeness of 0 with all; equal likenesses are in order of pattern_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS
from ..functions import series
from . import similarity

#: Bounds are sums in another order than the cost, so a pair this close to the bar is warped too.
SLACK = 1e-9


def shaped(rows: DataFrame, vector: str) -> DataFrame:
    """The series without mean and with unit deviation, and its extremes."""
    x, n = F.col(vector), F.size(vector)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    rows = rows.where(x.isNotNull()).withColumn(f"{vector}_mean", F.try_divide(total(x), n))
    square = total(F.transform(x, lambda v: (v - F.col(f"{vector}_mean")) * (v - F.col(f"{vector}_mean"))))
    rows = rows.withColumn(f"{vector}_dev", F.sqrt(F.try_divide(square, n)) + EPS)
    rows = rows.withColumn(vector, F.transform(x, lambda v: (v - F.col(f"{vector}_mean")) / F.col(f"{vector}_dev")))
    ends = F.struct(F.array_min(vector).alias("low"), F.array_max(vector).alias("high"))
    return rows.withColumn(f"{vector}_range", ends).drop(f"{vector}_mean", f"{vector}_dev")


def likeness(cost: Column, longest: Column) -> Column:
    return F.coalesce(F.exp(-F.try_divide(F.sqrt(cost), longest)), F.lit(0.0))


def bounded(pairs: DataFrame) -> DataFrame:
    """Pairs of shaped series with the least and the most that their likeness can be: sure, most."""
    a, b, n, m = F.col("q_vector"), F.col("vector"), F.size("q_vector"), F.size("vector")
    longest = F.greatest(n, m)
    gap = lambda x, y: (x - y) * (x - y)
    steps = F.sequence(F.lit(1), F.greatest(longest, F.lit(1)))
    diagonal = F.aggregate(steps, F.lit(0.0), lambda s, i: s + gap(F.try_element_at(a, F.least(i, n)), F.try_element_at(b, F.least(i, m))))

    def outside(x: Column, size: Column, ends: str) -> Column:
        far = lambda v: F.greatest(v - F.col(ends)["high"], F.col(ends)["low"] - v, F.lit(0.0))
        return F.aggregate(F.slice(x, 2, F.greatest(size - 2, F.lit(0))), F.lit(0.0), lambda s, v: s + far(v) * far(v))

    tips = gap(F.get(a, F.lit(0)), F.get(b, F.lit(0))) + F.when(longest > 1, gap(F.get(a, n - 1), F.get(b, m - 1))).otherwise(0.0)
    least = tips + F.greatest(outside(a, n, "vector_range"), outside(b, m, "q_vector_range"))
    return pairs.withColumn("sure", likeness(F.when(F.least(n, m) > 0, diagonal), longest)).withColumn("most", likeness(F.when(F.least(n, m) > 0, least), longest))


def candidates(patterns: DataFrame, queries: DataFrame, top_n: int = 20, but_itself: bool = False) -> DataFrame:
    """The pairs that can be among a query's best, shaped, with the query's bar."""
    blocks = similarity.blocks_of(queries)
    patterns, queries = shaped(patterns, "vector"), shaped(queries, "q_vector")
    pairs = lambda asked: bounded(similarity.paired(patterns, asked, but_itself=but_itself, blocks=blocks))
    best = Window.partitionBy("query_id").orderBy(F.desc("sure"))
    first = pairs(queries).select("query_id", "sure").withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_n)
    # The bar goes with the query, so the pairs are made again and filtered where they meet.
    bars = first.groupBy("query_id").agg(F.when(F.count("*") == top_n, F.min("sure")).otherwise(0.0).alias("bar"))
    return pairs(queries.join(bars, "query_id")).where(F.col("most") >= F.col("bar") - SLACK)


def find_warped(patterns: DataFrame, queries: DataFrame, top_n: int = 20, but_itself: bool = False) -> DataFrame:
    """(query_id, pattern_id, ticker, warp, rank): the best top_n of each query.

    Queries have ids of their own; each goes through the patterns twice, once for its bar.
    """
    rows = candidates(patterns, queries, top_n, but_itself)
    rows = rows.select("query_id", "pattern_id", "ticker", series.dtw_above(F.col("q_vector"), F.col("vector"), F.col("bar") - SLACK).alias("warp"))
    best = Window.partitionBy("query_id").orderBy(F.desc("warp"), "pattern_id")
    return rows.where("warp IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
