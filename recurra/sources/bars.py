"""Bar tables: (ticker, timeframe, ts, open, high, low, close, volume), from ticks or by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ("ticker", "timeframe", "ts", "open", "high", "low", "close", "volume")
# Bar lengths by label.
TIMEFRAMES = {
    "1m": "1 minute", "2m": "2 minutes", "5m": "5 minutes", "10m": "10 minutes", "15m": "15 minutes", "30m": "30 minutes",
    "1h": "1 hour", "2h": "2 hours", "4h": "4 hours", "1d": "1 day", "1w": "1 week",
}


def bar_length(timeframe: str) -> str:
    """The length of a bar; labels are read without case and spaces."""
    label = timeframe.lower().replace(" ", "")
    if label not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return TIMEFRAMES[label]


def validated(df: DataFrame, ticker: str | None = None, timeframe: str = "1h") -> DataFrame:
    """Lower-cased columns, a timestamp, and an error if one of the five bar columns is missing."""
    low = df.toDF(*(c.lower() for c in df.columns))
    missing = [c for c in ("open", "high", "low", "close", "volume") if c not in low.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    stamp = next((c for c in ("ts", "timestamp") if c in low.columns), None)
    if stamp is None:
        raise ValueError("no timestamp column")
    owner = F.lit(ticker) if ticker else F.col("ticker")
    values = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return low.select(owner.alias("ticker"), F.lit(timeframe).alias("timeframe"), F.to_timestamp(stamp).alias("ts"), *values)


def symbol(ticker: Column) -> Column:
    """Provider symbol: BTC-USD is X:BTCUSD, all else upper case."""
    up = F.upper(ticker)
    return F.when(up.contains("-USD"), F.concat(F.lit("X:"), F.replace(up, F.lit("-USD"), F.lit("")), F.lit("USD"))).otherwise(up)


def bars_from_ticks(ticks: DataFrame, order: list[str], timeframe: str = "1h") -> DataFrame:
    """Bars of (ticker, ts, price, size) ticks; `order` makes first and last unambiguous."""
    bucket = F.window("ts", bar_length(timeframe))["start"].alias("ts")
    by = F.struct(*order)
    return (
        ticks.groupBy("ticker", bucket)
        .agg(
            F.min_by("price", by).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", by).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("ticker", F.lit(timeframe).alias("timeframe"), "ts", "open", "high", "low", "close", "volume")
    )


def states_of(ticks: DataFrame, order: list[str], timeframe: str = "1m") -> DataFrame:
    """Mergeable bars: (ticker, ts, open, opened, high, low, close, closed, volume), with the places of the first and last tick."""
    by = F.struct(*order)
    bucket = F.window("ts", bar_length(timeframe))["start"].alias("ts")
    return ticks.groupBy("ticker", bucket).agg(
        F.min_by("price", by).alias("open"), F.min(by).alias("opened"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", by).alias("close"), F.max(by).alias("closed"), F.sum("size").alias("volume"),
    )


def merged_states(states: DataFrame, *keys: str) -> DataFrame:
    """States of equal keys made one; any order and any grouping of merges gives the same."""
    return states.groupBy(*keys).agg(
        F.min_by("open", "opened").alias("open"), F.min("opened").alias("opened"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "closed").alias("close"), F.max("closed").alias("closed"), F.sum("volume").alias("volume"),
    )


def bars_of_all(ticks: DataFrame, order: list[str], timeframes: tuple[str, ...] = tuple(TIMEFRAMES)) -> DataFrame:
    """Bars of many timeframes from one pass over the ticks.

    Ticks become states of the finest timeframe, which divides all others; a state goes into one bar of each timeframe,
    and what is shuffled for the coarse ones is states merged on the map side.
    """
    states = states_of(ticks, order, "1m")
    seconds = {t: _seconds(bar_length(t)) for t in timeframes}
    at = F.unix_seconds("ts")
    places = F.array(*(F.struct(F.lit(t).alias("timeframe"), F.timestamp_seconds(at - F.pmod(at, F.lit(n))).alias("start")) for t, n in seconds.items()))
    placed = states.withColumn("place", F.explode(places)).withColumns({"timeframe": F.col("place.timeframe"), "start": F.col("place.start")})
    found = merged_states(placed.drop("ts", "place"), "ticker", "timeframe", "start")
    return found.select("ticker", "timeframe", F.col("start").alias("ts"), "open", "high", "low", "close", "volume")


def _seconds(length: str) -> int:
    n, unit = length.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.removesuffix("s")]


def event_ticks(events: DataFrame) -> DataFrame:
    size = F.get_json_object("props", "$.k").cast("double")
    stamp = F.col("ts").cast("timestamp").alias("ts")
    return events.select(F.col("event_type").alias("ticker"), stamp, F.col("value").alias("price"), size.alias("size"), "event_id")


def bars_events(events: DataFrame, timeframe: str = "1h") -> DataFrame:
    """Bars of an event stream, a ticker per event type."""
    return bars_from_ticks(event_ticks(events), ["event_id"], timeframe)


def bars_smooth(events: DataFrame, length: int = 200) -> DataFrame:
    """Hourly bars of the running mean over `length` events."""
    recent = Window.partitionBy("ticker").orderBy("event_id").rowsBetween(1 - length, 0)
    return bars_from_ticks(event_ticks(events).withColumn("price", F.avg("price").over(recent)), ["event_id"])


def bars_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars of unit prices, a ticker per supplier."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    ticks = lineitem.select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("ts"), price.alias("price"),
        F.col("l_quantity").alias("size"), *order,
    )
    return bars_from_ticks(ticks, order, "1d")


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    last = Window.partitionBy("ticker", "timeframe").orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def synthetic_bars(spark: SparkSession, tickers: list[str], n: int = 300, regime: str = "trending", seed: int = 7) -> DataFrame:
    """Seeded random walks by regime.

    A walk is a product of independent steps, so a windowed sum of logarithms gives it.  mean_reverting is pulled back
    to its first price: its relative distance is a sum of steps that fade by a constant rate, a windowed sum too.
    """
    names = F.explode(F.array(*(F.lit(t) for t in tickers))).alias("ticker")
    rows = spark.range(n).select(names, F.col("id").alias("i"))
    phase = (F.col("i") / 50).cast("int") % 3
    # Drift and noise of the regimes.
    drift = {"trending": F.lit(0.0005), "volatile": F.element_at(F.array(F.lit(0.001), F.lit(-0.001), F.lit(0.0)), phase + 1), "compression": F.lit(0.0001)}
    noise = {"trending": F.lit(0.015), "mean_reverting": F.lit(0.012), "volatile": F.element_at(F.array(F.lit(0.025), F.lit(0.03), F.lit(0.01)), phase + 1), "compression": 0.025 * (1 - F.col("i") / n) + 0.005}

    def normal(salt: int) -> Column:
        """Box-Muller on hashes, so that a row's draw doesn't depend on its partition."""
        unit = lambda k: (F.pmod(F.xxhash64("ticker", "i", F.lit(regime), F.lit(seed * 100 + salt + k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))

    step = drift.get(regime, F.lit(0.0)) + noise.get(regime, F.lit(0.02)) * normal(0)
    rows = rows.withColumn("ret", F.when(F.col("i") == 0, 0.0).otherwise(F.greatest(step, F.lit(-0.9))))
    path = Window.partitionBy("ticker").orderBy("i")
    base = 10 + F.pmod(F.xxhash64("ticker", F.lit(seed)), F.lit(490))
    if regime == "mean_reverting":
        fade = 1 - 0.3 / n  # fixed value: the share of the distance that each step takes back
        away = F.sum(F.col("ret") * F.pow(F.lit(fade), -F.col("i"))).over(path) * F.pow(F.lit(fade), F.col("i"))
        rows = rows.withColumn("close", base * F.greatest(1 + away, F.lit(0.05)))
    else:
        rows = rows.withColumn("close", base * F.exp(F.sum(F.log1p("ret")).over(path)))
    spread = F.abs(0.005 * normal(10))
    stamp = F.timestamp_seconds(F.lit(1577836800) + F.col("i") * 3600)
    volume = F.exp(10 + 0.5 * normal(20)) * (1 + 5 * F.abs("ret"))
    opened = F.coalesce(F.lag("close").over(path), F.col("close"))
    return rows.select(
        "ticker", F.lit("1h").alias("timeframe"), stamp.alias("ts"), opened.alias("open"), (F.col("close") * (1 + spread)).alias("high"),
        (F.col("close") * (1 - spread)).alias("low"), "close", volume.alias("volume"),
    )
