"""Normalisers over a vector column; statistics are per dimension over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS

#: Parts that a dimension is ranked in.
SLICES = 64
METHODS = ("zscore", "minmax", "rank", "combined")


def fit(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """One row: arrays of mean, population deviation, least and greatest by dimension."""
    long = vectors.select(F.posexplode(column).alias("d", "x"))
    stats = long.groupBy("d").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + EPS).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    rows = F.array_sort(F.collect_list(F.struct("d", "mean", "std", "low", "high")))
    return stats.agg(F.transform(rows, lambda r: F.struct(r["mean"].alias("mean"), r["std"].alias("std"), r["low"].alias("low"), r["high"].alias("high"))).alias("stats"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def places_of(long: DataFrame, slices: int = SLICES) -> DataFrame:
    """(d, x, place): the average rank of each distinct value in its dimension.

    A dimension has as many values as there are rows, so it is cut into slices at its quantiles: a value's rank is
    what lies in lower slices and what is lower in its own.  The cuts are read once (slices per dimension) so that
    every task uses the same ones.
    """
    steps = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    cuts = long.groupBy("d").agg(F.percentile_approx("x", steps, F.lit(10 * slices)).alias("cuts")).collect()
    known = long.sparkSession.createDataFrame([tuple(r) for r in cuts], "d int, cuts array<double>")
    held = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("x"))), F.lit(0))
    values = long.groupBy("d", "x").agg(F.count("*").alias("same")).join(F.broadcast(known), "d").select("d", "x", "same", held.alias("slice"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy("d", "slice").agg(F.sum("same").alias("size"))
    lower = sums.select("d", "slice", F.coalesce(F.sum("size").over(before("d").orderBy("slice")), F.lit(0)).alias("lower"))
    inside = F.coalesce(F.sum("same").over(before("d", "slice").orderBy("x")), F.lit(0))
    ranked = values.withColumn("inside", inside).join(F.broadcast(lower), ["d", "slice"])
    return ranked.select("d", "x", (F.col("lower") + F.col("inside") + (F.col("same") + 1) / 2.0).alias("place"))


def transform(vectors: DataFrame, fitted: DataFrame, method: str = "combined", column: str = "vector") -> DataFrame:
    """The table with its vectors normalised by statistics that were fitted to another one (the row of `fit`, broadcast).

    A single vector has no ranks, so `rank` is the logistic of its standard score.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    z = lambda x, s: (x - s["mean"]) / s["std"]
    rules = {"zscore": z, "minmax": lambda x, s: (x - s["low"]) / (s["high"] - s["low"] + EPS)}
    rule = rules.get(method, lambda x, s: sigmoid(z(x, s)))
    held = fitted.select(F.col("stats").alias("__stats"))
    return vectors.join(F.broadcast(held)).withColumn(column, F.zip_with(column, "__stats", rule)).drop("__stats")


def normalised(vectors: DataFrame, method: str = "combined", key: str = "pattern_id", column: str = "vector") -> DataFrame:
    """(key, column): a population normalised by its own statistics, or by the ranks in it."""
    if method != "rank":
        return transform(vectors.select(key, column), fit(vectors, column), method, column)
    long = vectors.select(key, F.posexplode(column).alias("d", "x"))
    count = vectors.select(F.count("*").alias("n"))
    places = places_of(long).select(F.col("d").alias("pd"), F.col("x").alias("px"), "place")
    placed = long.join(places, (F.col("d") == F.col("pd")) & F.col("x").eqNullSafe(F.col("px"))).join(F.broadcast(count))
    entry = F.struct("d", (F.col("place") / (F.col("n") + 1)).alias("v"))
    return placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(column))
