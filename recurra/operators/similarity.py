"""Queries against stored patterns: scores, threshold, the best of them.

Patterns have (pattern_id, ticker, vector, ...); queries (query_id, q_ticker,
q_vector).  A few queries are broadcast and patterns only scanned; more are dealt into tiles of both tables, each
worked on as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import series, tiles
from ..functions import vectors as V

#: Query vectors that one broadcast holds, or about so many when there are more.
QUERY_BLOCK = 10_000
#: Up to so many queries are broadcast to where patterns are scanned.
FEW = 64
#: Patterns and queries of a tile, about: where the best are searched, and where every pair is a row.
SEARCHED, LISTED = (32_768, 1_024), (1_024, 1_024)
SCORES = ("cosine", "euclidean", "dtw", "composite")


def blocks_of(queries: DataFrame, block: int = QUERY_BLOCK) -> int:
    """How many broadcasts hold the queries."""
    return 1 if len(queries.select("query_id").head(block + 1)) <= block else -(-queries.count() // block)


def paired(patterns: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK, but_itself: bool = False, blocks: int | None = None) -> DataFrame:
    """Every pattern with every query of a stated set and the norms of both, worked out once a row, not once a pair.

    but_itself leaves out pairs of equal ids, for queries that are patterns too.

    Beyond one block the queries are dealt by their hash, and each block scans the patterns.  blocks, where it is known,
    spares counting them.
    """
    patterns = patterns.withColumn("norm", V.norm(F.col("vector")))
    queries = queries.withColumn("q_norm", V.norm(F.col("q_vector")))
    other = F.col("pattern_id") != F.col("query_id") if but_itself else None
    blocks = blocks_of(queries, block) if blocks is None else blocks
    if blocks == 1:
        return patterns.join(F.broadcast(queries), other)
    turn = F.pmod(F.xxhash64("query_id", "q_vector"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [patterns.join(F.broadcast(queries.where(turn == b)), other) for b in range(blocks)])


def tiled(patterns: DataFrame, queries: DataFrame, rows: tuple[int, int], rule: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """The rule over tiles of about so many patterns and queries; each pattern meets each query in one of them.

    A side is dealt by its hash, and goes to as many tiles as the other side has parts; a small query set still has a few.
    """
    asked = queries.count()
    parts = {"__p": max(1, -(-patterns.count() // rows[0])), "__q": max(1, -(-asked // rows[1]), min(4, asked // 64))}
    tasks = min(parts["__p"] * parts["__q"], 4 * int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, own: str, other: str, *key: str):
        df = df.withColumn(own, F.pmod(F.xxhash64(*key), F.lit(parts[own])).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))))
        return df.repartition(tasks, "__p", "__q").groupBy("__p", "__q")  # a number, as tiles are dear and their rows few

    return dealt(patterns, "__p", "__q", "pattern_id", "vector").cogroup(dealt(queries, "__q", "__p", "query_id", "q_vector")).applyInArrow(rule, schema)


def listed(patterns: DataFrame, queries: DataFrame, rule: Callable, names: tuple[str, ...], but_itself: bool = False, mixed: bool = False) -> DataFrame:
    """(query_id, pattern_id, the rule's values) of every pattern with every query of a stated set.

    mixed lets vectors of different lengths have values.
    """
    schema = StructType([queries.schema["query_id"], patterns.schema["pattern_id"], *(StructField(n, DoubleType()) for n in names)])
    arrow = to_arrow_schema(schema)
    sides = patterns.select("pattern_id", "vector"), queries.select("query_id", "q_vector")
    return tiled(*sides, LISTED, lambda p, q: tiles.every(p, q, rule, names, arrow, but_itself, mixed), schema)


def searched(patterns: DataFrame, queries: DataFrame, weights: tuple[float, float, float], threshold: float, top_n: int, but_itself: bool) -> DataFrame:
    """Rows of both tables without their vectors, with scores; each query's best of each tile."""
    kept = [*(f for f in patterns.schema if f.name != "vector"), *(f for f in queries.schema if f.name != "q_vector")]
    schema = StructType([*kept, *(StructField(n, DoubleType()) for n in SCORES)])
    arrow = to_arrow_schema(schema)
    return tiled(patterns, queries, SEARCHED, lambda p, q: tiles.searched(p, q, weights, threshold, top_n, arrow, but_itself), schema)


def many(queries: DataFrame) -> bool:
    return len(queries.select("query_id").head(FEW + 1)) > FEW


def scored(patterns: DataFrame, queries: DataFrame, cross_asset: bool = True, but_itself: bool = False, blocks: int | None = None) -> DataFrame:
    """Every pattern with every query of a stated set: cosine, euclidean."""
    if cross_asset:
        pairs = paired(patterns, queries, but_itself=but_itself, blocks=blocks)
    else:
        # Queries of a ticker meet its patterns alone, by a join; one without a ticker meets all.
        named = F.coalesce(F.col("q_ticker"), F.lit("")) != ""
        other = [F.col("pattern_id") != F.col("query_id")] if but_itself else []
        own = patterns.withColumn("norm", V.norm(F.col("vector"))).join(queries.where(named).withColumn("q_norm", V.norm(F.col("q_vector"))), [F.col("ticker") == F.col("q_ticker"), *other])
        pairs = own.unionByName(paired(patterns, queries.where(~named), but_itself=but_itself))
    a, b = F.col("q_vector"), F.col("vector")
    cosine = V.cosine_of(V.dot(a, b), F.col("q_norm"), F.col("norm"))
    return pairs.withColumn("cosine", cosine).withColumn("euclidean", V.euclidean(a, b)).drop("norm", "q_norm")


def ranked(rows: DataFrame, top_n: int) -> DataFrame:
    """The best top_n of each query, ties by pattern id; ranks from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("composite"), "pattern_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (top_n or 20))


def find_matches(
    patterns: DataFrame, queries: DataFrame, top_n: int = 20, threshold: float = 0.5, cross_asset: bool = True,
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2), but_itself: bool = False,
) -> DataFrame:
    """Exact composite of cosine, euclidean and cross-correlation; rows of both sides without their vectors.

    Cross-correlation is at most 1, so patterns that can't reach the threshold are dropped before it is worked out.
    """
    c, e, x = weights
    if cross_asset and many(queries):
        return ranked(searched(patterns, queries, weights, threshold, top_n or 20, but_itself), top_n)
    rows = scored(patterns, queries, cross_asset, but_itself, 1 if cross_asset else None)
    rows = rows.where(c * F.col("cosine") + e * F.col("euclidean") + x >= threshold)
    rows = rows.withColumn("dtw", series.xcorr(F.col("q_vector"), F.col("vector")))
    rows = rows.withColumn("composite", c * F.col("cosine") + e * F.col("euclidean") + x * F.col("dtw"))
    return ranked(rows.where(F.col("composite") >= threshold).drop("vector", "q_vector"), top_n)


def find_matches_batch(patterns: DataFrame, queries: DataFrame, top_n: int = 20, threshold: float = 0.5, but_itself: bool = False) -> DataFrame:
    """Without cross-correlation, whose weight goes to the other two in equal parts; all tickers."""
    weights = (0.6, 0.4, 0.0)
    if many(queries):
        return ranked(searched(patterns, queries, weights, threshold, top_n or 20, but_itself), top_n)
    rows = scored(patterns, queries, True, but_itself, 1).withColumn("dtw", F.lit(0.0))
    rows = rows.withColumn("composite", weights[0] * F.col("cosine") + weights[1] * F.col("euclidean"))
    return ranked(rows.where(F.col("composite") >= threshold).drop("vector", "q_vector"), top_n)


def rerank(matches: DataFrame, diversity: bool = True) -> DataFrame:
    """Up to 0.05 more for tickers under 30 % of a query's matches; composite itself stays."""
    query = Window.partitionBy("query_id")
    share = F.count("*").over(Window.partitionBy("query_id", "ticker")) / F.count("*").over(query)
    bonus = F.when(F.lit(diversity) & (share < 0.3), 0.05 * (1 - share)).otherwise(0.0)
    rows = matches.withColumn("adjusted", F.col("composite") + bonus)
    return rows.withColumn("rank", F.row_number().over(query.orderBy(F.desc("adjusted"), "rank")).cast("int")).drop("adjusted")


def confidence_of() -> Column:
    """Of the first score, the mean and the spread; an aggregate over a query's matches."""
    first = F.min_by("composite", "rank")
    value = 0.5 * first + 0.3 * F.avg("composite") + 0.2 * (1 - F.least(F.stddev_pop("composite"), F.lit(1.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def confidence(matches: DataFrame) -> DataFrame:
    """(query_id, confidence)."""
    return matches.groupBy("query_id").agg(confidence_of().alias("confidence"))
