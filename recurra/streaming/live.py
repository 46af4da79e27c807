"""Bars, newest windows, scans and alerts over unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import EngineConfig
from ..plans import scan as plans
from ..sources.bars import bar_length
from ..sources.results import write_results

WINDOW = "ticker string, timeframe string, k int, i int, ts timestamp, open double, high double, low double, close double, volume double"
VALUES = ["open", "high", "low", "close", "volume"]


def stream_bars(ticks: DataFrame, timeframe: str = "1h", delay: str = "2 hours") -> DataFrame:
    """Bars of a stream of (ticker, ts, price, size, event_id); late ticks within `delay` count."""
    by = F.struct("event_id")  # as in the bars of a table
    marked = ticks.withWatermark("ts", delay)
    found = marked.groupBy("ticker", F.window("ts", bar_length(timeframe))).agg(
        F.min_by("price", by).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", by).alias("close"), F.sum("size").alias("volume")
    )
    return found.select("ticker", F.lit(timeframe).alias("timeframe"), F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def newest_windows(bars: DataFrame, window: int = 60) -> DataFrame:
    """The newest `window` bars of each series that got bars, as rows of WINDOW; series with fewer are silent.

    The state of a series is those bars as one binary value: times, then five values each.  Of bars with one time the
    last that came counts; bars older than all that are held change nothing, as they are in no newest window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(bytes(state.get[0])).reshape(6, -1) if state.exists else np.zeros((6, 0))
        ts, values = held[0].view(np.int64), held[1:]
        for batch in batches:
            fresh = batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            ts, values = np.append(ts, fresh), np.hstack([values, batch[VALUES].to_numpy(float).T])
        # The last of equal times is the first of the reversed.
        ts, at = np.unique(ts[::-1], return_index=True)
        values = values[:, ::-1][:, at][:, -window:]
        ts = ts[-window:]
        state.update((np.vstack([ts.view(float), values]).tobytes(),))
        if len(ts) == window:
            named = {"ticker": key[0], "timeframe": key[1], "k": 0, "i": np.arange(window, dtype=np.int32), "ts": ts.view("datetime64[us]")}
            yield pd.DataFrame(named | dict(zip(VALUES, values)))

    grouped = bars.select("ticker", "timeframe", "ts", *VALUES).groupBy("ticker", "timeframe")
    return grouped.applyInPandasWithState(step, WINDOW, "body binary", "append", "NoTimeout")


def scan_sink(path: str, patterns: Callable[[SparkSession], DataFrame], config: EngineConfig = EngineConfig(), cross_asset: bool = True):
    """A foreachBatch function: the windows of a batch are scanned and the results written once, under its number.

    The windows are written first, so the state behind them is worked out once and a result can be traced to its bars.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = f"{path}/windows/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        windows = spark.read.schema(WINDOW).parquet(at)
        write_results(plans.echoes(windows, patterns(spark), config, cross_asset), f"{path}/results", number)

    return write


def scan_stream(bars: DataFrame, path: str, patterns: Callable[[SparkSession], DataFrame], config: EngineConfig = EngineConfig(), cross_asset: bool = True) -> DataStreamWriter:
    """A stream of bars to scan results under `path`, with its checkpoint there; the caller sets the trigger and starts it."""
    sink = scan_sink(path, patterns, config, cross_asset)
    return newest_windows(bars, config.window).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")


def cooled_stream(alerts: DataFrame, hours: int = 8) -> DataFrame:
    """Alerts (ticker, ts) outside the cooldown of the last one sent; the state is that time, by ticker."""
    gap = pd.Timedelta(hours=hours)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        sent = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            if last is None or ts - last >= gap:
                sent.append(ts)
                last = ts
        if last is not None:
            state.update((last.value // 1000,))
        yield pd.DataFrame({"ticker": [key[0]] * len(sent), "ts": sent})

    grouped = alerts.groupBy("ticker")
    return grouped.applyInPandasWithState(step, "ticker string, ts timestamp", "last long", "append", "NoTimeout")
