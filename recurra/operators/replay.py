"""Stored patterns of a series in order, and where their label changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SERIES = ("ticker", "timeframe")


def indexed(patterns: DataFrame) -> DataFrame:
    """`index` from 0 by start time within each series, whatever ingest a pattern came with."""
    order = Window.partitionBy(*SERIES).orderBy("start_time", "end_time")
    return patterns.withColumn("index", F.row_number().over(order) - 1)


def timeline(patterns: DataFrame, limit: int = 100) -> DataFrame:
    """(ticker, timeframe, index, start_time, end_time, rounded outcome, label, profiles) of the first `limit` patterns of each series.

    Profiles that the patterns don't have are null.
    """
    rows = indexed(patterns).where(F.col("index") < limit)
    profiles = [F.col(c) if c in patterns.columns else F.lit(None).cast("string").alias(c) for c in ("volatility_profile", "momentum_profile")]
    outcome = [F.bround(c, 4).alias(c) for c in ("forward_return", "max_drawdown")]
    return rows.select(*SERIES, "index", "start_time", "end_time", *outcome, "outcome_label", *profiles)


def transitions(patterns: DataFrame) -> DataFrame:
    """(ticker, timeframe, index, start_time, from, to) where a label differs from the last one that wasn't empty."""
    order = Window.partitionBy(*SERIES).orderBy("index")
    label = F.when(F.col("outcome_label") != "", F.col("outcome_label"))
    rows = indexed(patterns).withColumn("own", label)
    rows = rows.withColumn("before", F.last("own", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where(F.col("own") != F.col("before")).select(*SERIES, "index", "start_time", F.col("before").alias("from_label"), F.col("own").alias("to_label"))
