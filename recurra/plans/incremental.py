"""Ingest of new bars into an archive: only windows that are new, or that late bars have moved, are cut.

A series' state is the number of its next window and the bars from its start on.
Bars after the last one held go behind them, and windows are cut from there.  If
a bar is late, or comes again with other values, the first window that it lies in
or before is found by its place among the bars held, and windows are cut anew
from that one on.  Windows that end before it stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.windows import latest_window
from ..sources.archive import SERIES, Archive, spans_of
from ..sources.bars import BAR_COLUMNS, bar_length
from . import scan as plans

VALUES = ("open", "high", "low", "close", "volume")


def arrivals(source: DataFrame, archive: Archive, timeframe: str = "1h", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Bars of a table that the archive has not got, as far as one window and horizon before its newest bar.

    The bound is a constant, so the scan of the table skips what lies before it, as does that of the archive.  Bars
    that come later than that go to `ingest` by themselves.
    """
    rows = source.select(*BAR_COLUMNS)
    if archive.newest is None:
        return rows
    since = F.expr(f"timestamp_micros({archive.newest}) - {config.window + config.horizon} * INTERVAL {bar_length(timeframe)}")
    held = archive.bars(timeframe).where(F.col("ts") >= since)
    return rows.where(F.col("ts") >= since).join(held, [*SERIES, "ts", *VALUES], "left_anti")


def _places(archive: Archive, new: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(plan, bars): of each series with new bars the window to cut from, and all bars from that window's start on.

    The archive's own bars are read only if a series has late ones, and then only the slots of such series.
    """
    touched = new.groupBy(*SERIES).agg(F.min("ts").alias("first_new"))
    fresh = new.select(*BAR_COLUMNS)
    if archive.last is None:
        return touched.select(*SERIES, F.lit(0).cast("long").alias("k0"), F.lit(0).cast("long").alias("next_k")), fresh
    state = touched.join(archive.tails(), SERIES, "left").persist()  # one row a series
    on_time = state.where("last_ts IS NULL OR first_new > last_ts")
    plan = on_time.select(*SERIES, F.coalesce("next_k", F.lit(0)).alias("k0"), F.coalesce("next_k", F.lit(0)).alias("next_k"))
    old = on_time.select(*SERIES, F.inline("bars")).select(*BAR_COLUMNS)
    late = state.where("first_new <= last_ts").select(*SERIES, "first_new", "next_k")
    slots = [r[0] for r in late.select(archive.slot(F.col("ticker"))).distinct().collect()]  # no more than the archive has
    if slots:
        size = config.window + config.horizon
        place = F.row_number().over(Window.partitionBy(*SERIES).orderBy("ts")) - 1
        held = archive.bars(slots=slots).join(late, SERIES).withColumn("place", place)
        # How many bars lie before the first late one says which windows are the first to change.
        before = held.groupBy(*SERIES).agg(F.count_if(F.col("ts") < F.col("first_new")).alias("before"), F.first("next_k").alias("next_k"))
        moved = F.greatest(F.lit(0), F.floor((F.col("before") - size) / config.stride) + 1)
        again = before.select(*SERIES, F.least(moved, F.col("next_k")).alias("k0"), "next_k")
        old = old.unionByName(held.drop("next_k").join(again, SERIES).where(F.col("place") >= F.col("k0") * config.stride).select(*BAR_COLUMNS))
        plan = plan.unionByName(again)
    every = old.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)))
    bars = every.groupBy(*SERIES, "ts").agg(F.max_by(F.struct(*VALUES), "fresh").alias("b")).select(*SERIES, "ts", "b.*")
    return plan, bars


def _tails(bars: DataFrame, plan: DataFrame, config: EngineConfig) -> DataFrame:
    """The states after an ingest: how far windows were cut, and the bars from the next one's start on."""
    size, whole = config.window + config.horizon, Window.partitionBy(*SERIES)
    rows = bars.withColumn("n", F.count("*").over(whole)).withColumn("place", F.row_number().over(whole.orderBy("ts")) - 1)
    rows = rows.withColumn("cut", F.when(F.col("n") >= size, F.floor((F.col("n") - size) / config.stride) + 1).otherwise(0))
    kept = F.collect_list(F.when(F.col("place") >= F.col("cut") * config.stride, F.struct("ts", *VALUES)))  # under a window, a horizon and a stride
    found = rows.groupBy(*SERIES).agg(F.max("cut").alias("cut"), F.max("ts").alias("last_ts"), F.array_sort(kept).alias("bars"))
    return found.join(plan, SERIES).select(*SERIES, (F.col("k0") + F.col("cut")).alias("next_k"), "last_ts", "bars")


def ingest(new: DataFrame, archive: Archive, number: int | None = None, config: EngineConfig = EngineConfig()) -> int:
    """Bars to archived patterns; how many were written.

    A number that is not above the last ingest's is done already and writes nothing.  Of bars with equal times that
    come at once the one with the largest values counts.
    """
    number = (0 if archive.last is None else archive.last + 1) if number is None else number
    if archive.last is not None and number <= archive.last:
        return 0
    rows = new.where(F.col("ts").isNotNull() & F.col("ticker").isNotNull())
    rows = rows.groupBy(*SERIES, "ts").agg(F.max(F.struct(*VALUES)).alias("b")).select(*SERIES, "ts", "b.*")
    rows = archive.put("bars", rows, number)
    plan, bars = _places(archive, rows, config)
    plan, bars = plan.persist(), bars.persist()
    made = plans.patterns_of(bars, config).join(plan.select(*SERIES, "k0"), SERIES).withColumn("k", F.col("k") + F.col("k0"))
    made = archive.put("patterns", made, number)
    archive.put("spans", spans_of(made), number)
    archive.put("tails", _tails(bars, plan, config), number)
    cuts = archive.put("cuts", plan.where("k0 < next_k").select(*SERIES, F.col("k0").alias("from_k")), number)
    newest, n, n_cuts = bars.agg(F.max(F.unix_micros("ts"))).first()[0], made.count(), cuts.count()
    bars.unpersist()
    plan.unpersist()
    if archive.newest is not None:
        newest = max(x for x in (newest, archive.newest) if x is not None)
    archive.commit(number, newest, n, n_cuts)
    return n


def scan_archive(bars: DataFrame, archive: Archive, timeframe: str = "1h", config: EngineConfig = EngineConfig(), cross_asset: bool = True, limit: int | None = None) -> DataFrame:
    """The scan of each series' newest window against what the archive has of a timeframe, `limit` patterns at most if given."""
    return plans.scan(bars, archive.patterns(timeframe, limit=limit), None, config, timeframe, cross_asset)


def echoes_of(bars: DataFrame, archive: Archive, timeframe: str = "1h", config: EngineConfig = EngineConfig(), cross_asset: bool = True) -> DataFrame:
    """Results with nested matches of each series' newest window."""
    return plans.echoes(latest_window(bars, config.window), archive.patterns(timeframe), config, cross_asset)
