"""Overlapping windows of a bar table with their forward outcomes.

Window k of a series covers bars k*stride to k*stride+window-1; the `horizon`
bars after it are its future.  Each bar is expanded into the windows that hold
it, so no join is needed, and everything after works within (ticker, k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("ticker", "timeframe", "k")


def rolling_windows(bars: DataFrame, window: int = 60, horizon: int = 20, step: int = 30) -> DataFrame:
    """One row per window and bar: (ticker, timeframe, k, i, ..., n); i >= window is the future, n counts a window's bars with it."""
    series = Window.partitionBy("ticker", "timeframe")
    placed = bars.withColumn("pos", F.row_number().over(series.orderBy("ts")) - 1).withColumn("n", F.count("*").over(series))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - (window + horizon - 1)) / F.lit(step))).cast("int")
    spread = placed.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("pos") / step).cast("int"))))
    spread = spread.where(F.col("k") * step + window + horizon <= F.col("n"))
    return spread.withColumn("i", F.col("pos") - F.col("k") * step).drop("pos", "n").withColumn("n", F.lit(window + horizon).cast("long"))


def latest_window(bars: DataFrame, window: int = 60) -> DataFrame:
    """The last `window` bars of each series that has as many; k is 0, n is `window`."""
    series = Window.partitionBy("ticker", "timeframe")
    placed = bars.withColumn("r", F.row_number().over(series.orderBy(F.desc("ts")))).withColumn("n", F.count("*").over(series))
    placed = placed.where((F.col("n") >= window) & (F.col("r") <= window))
    return placed.withColumn("k", F.lit(0)).withColumn("i", window - F.col("r")).drop("r", "n").withColumn("n", F.lit(window).cast("long"))


def forward_outcomes(windows: DataFrame, window: int = 60) -> DataFrame:
    """Return, worst and best move from the entry close, and the bar of the largest move (the first of equals)."""
    entry = F.max(F.when(F.col("i") == window - 1, F.col("close"))).over(Window.partitionBy(*KEY))
    rows = windows.withColumn("e", F.when(entry == 0, 1e-8).otherwise(entry))
    future = F.col("i") >= window
    move = (F.col("close") - F.col("e")) / F.col("e")
    after = lambda x: F.when(future, x)
    found = rows.groupBy(*KEY).agg(
        F.min(F.when(F.col("i") == 0, F.col("ts"))).alias("start_time"),
        F.max(F.when(F.col("i") == window - 1, F.col("ts"))).alias("end_time"),
        F.max(F.when(F.col("i") == 0, F.col("open"))).alias("first_open"),
        F.max(F.when(F.col("i") == window - 1, F.col("close"))).alias("last_close"),
        F.max(F.when(~future, F.col("high"))).alias("max_high"),
        F.min(F.when(~future, F.col("low"))).alias("min_low"),
        F.max_by(after(move), after(F.col("i"))).alias("forward_return"),
        F.min(after(move)).alias("max_drawdown"),
        F.max(after(move)).alias("max_runup"),
        (F.min_by(F.col("i"), after(F.struct(-F.abs(move), F.col("i")))) - (window - 1)).cast("int").alias("time_to_resolution"),
    )
    return found.fillna(0.0, ["forward_return", "max_drawdown", "max_runup"])
