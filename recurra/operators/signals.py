"""Scores, grades, directives and alerts of scans; the time is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

CONFIG = EngineConfig()
# Names of setups by echo type.
SETUPS = {
    "explosive_continuation": "Structural Surge", "slow_grind_continuation": "Absorption Grind", "full_reversal": "Regime Rejection",
    "fake_breakout_failure": "Expansion Trap", "volatility_expansion_directionless": "Volatility Squeeze", "whipsaw_continuation": "Shakeout Resolution",
}
# Colours as RGB numbers.
COLORS = {"up": 0x00FF88, "down": 0xFF4444, "flat": 0x888888}
# Minutes of a bar by label; labels that are not here count as an hour.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}


def cycle_day(as_of: Column, config: EngineConfig = CONFIG) -> Column:
    since = (F.unix_micros(as_of) - F.unix_micros(F.to_timestamp(F.lit(config.cycle_start)))) / 86_400e6
    return F.pmod(since, F.lit(config.cycle_days))


def proximity(day: Column, config: EngineConfig = CONFIG) -> Column:
    return F.least(day, config.cycle_days - day)


def cycle_phase(day: Column, config: EngineConfig = CONFIG) -> Column:
    near = proximity(day, config)
    return F.when(near < 5, "critical_convergence").when(near < 15, "elevated_cohesion").when(day < config.cycle_days / 2, "expanding_gap").otherwise("contracting_gap")


def score(similarity: Column, mean: Column, std: Column, probability: Column, day: Column, confidence: Column, config: EngineConfig = CONFIG) -> Column:
    """0 to 100, one decimal."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    factors = (similarity * 100, clip(mean / F.greatest(F.lit(0.01), std) * 50), probability * 100, F.greatest(F.lit(0.0), 100 - proximity(day, config) * (100 / 30)), confidence * 100)
    return F.round(sum((w * f for w, f in zip(config.score_weights, factors)), F.lit(0.0)), 1)


def grade(value: Column, config: EngineConfig = CONFIG) -> Column:
    out = F.lit("F")
    for name, least in reversed(config.grades):
        out = F.when(value >= least, name).otherwise(out)
    return out


def setup_name(echo_type: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SETUPS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, echo_type), F.lit("Structural Recurrence"))


def directives(price: Column, expected: Column, avg_drawdown: Column, config: EngineConfig = CONFIG) -> list[Column]:
    """target, stop and reward to risk; null without a price or expectation."""
    buffer = F.greatest(F.lit(config.risk_floor), avg_drawdown * config.risk_scale)
    usable = expected.isNotNull() & (price > 0)
    stop = F.when(expected > 0, price * (1 - buffer)).otherwise(price * (1 + buffer))
    return [F.when(usable, price * (1 + expected)).alias("target"), F.when(usable, stop).alias("stop"), F.when(usable, F.abs(expected / buffer)).alias("reward_risk")]


def direction_color(expected: Column) -> Column:
    """Green for a gain, red for a loss, grey for neither."""
    return F.when(expected > 0, COLORS["up"]).when(expected < 0, COLORS["down"]).otherwise(COLORS["flat"])


def rank_tier(ticker: Column, price: Column, mega_caps: tuple[str, ...] = (), config: EngineConfig = CONFIG) -> Column:
    """ALPHA for small prices, BENCHMARK for mega caps and high prices, else BETA."""
    large = ticker.isin(*mega_caps) | (price > config.max_price) if mega_caps else price > config.max_price
    return F.when(price.between(*config.small_prices), "ALPHA").when(large, "BENCHMARK").otherwise("BETA")


def trade_cards(projections: DataFrame, as_of: Column, mega_caps: tuple[str, ...] = (), config: EngineConfig = CONFIG) -> DataFrame:
    """(query_id, score, grade, card): projections (with the newest match's close as `price`) as JSON cards.

    No matches or no confidence make a card of grade F that only says so.
    """
    c, day = F.col, cycle_day(as_of, config)
    p = c("primary.expected_return")
    value = score(c("similarity"), c("mean_return"), c("return_std"), c("primary.probability"), day, c("confidence"), config)
    usable = F.coalesce((c("n_matches") > 0) & (c("confidence") > 0), F.lit(False))
    found = projections.withColumn("score", F.when(usable, value).otherwise(0.0)).withColumn("grade", F.when(usable, grade(value, config)).otherwise("F"))
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    levels = F.struct(c("price").alias("entry"), *directives(c("price"), p, c("avg_drawdown"), config))
    full = F.struct(
        F.concat(c("q_ticker"), F.lit(" ("), c("timeframe"), F.lit(")")).alias("title"), direction_color(p).alias("color"),
        rank_tier(c("q_ticker"), c("price"), mega_caps, config).alias("rank"), setup_name(c("echo_type")).alias("setup"), c("grade"), c("score"),
        c("confidence"), p.alias("expected_return"), c("primary.probability").alias("probability"), c("time_horizon"), cycle_phase(day, config).alias("cycle_phase"),
        F.when(c("price") > 0, levels).alias("directives"), c("narrative"), stamp,
    )
    short = F.struct(F.concat(F.lit("No usable data: "), c("q_ticker")).alias("title"), F.lit(COLORS["down"]).alias("color"), c("grade"), stamp)
    return found.select("query_id", "score", "grade", F.when(usable, F.to_json(full)).otherwise(F.to_json(short)).alias("card"))


def time_horizon(bars: Column, timeframe: Column) -> Column:
    """Text of a number of bars; unknown timeframes count as an hour."""
    each = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair)), timeframe), F.lit(60))
    m = bars * each
    text = lambda x: F.bround(x, 0).cast("long").cast("string")
    span = lambda x, unit: F.concat(text(x), F.lit("-"), text(x + 1), F.lit(f" {unit}"))
    return F.when(m < 60, F.concat(text(m), F.lit(" minutes"))).when(m < 1440, F.concat(text(m / 60), F.lit(" hours"))).when(m < 10080, span(m / 1440, "sessions")).otherwise(span(m / 10080, "weeks"))


def alert_gate(
    scans: DataFrame, mega_caps: tuple[str, ...] = (), config: EngineConfig = CONFIG, sent: DataFrame | None = None, now: Column | None = None
) -> DataFrame:
    """Scans (ticker, cycle, confidence, score, price) that may alert; one mega cap a cycle, the first by ticker.

    An unknown price counts as 0.  With `sent` (ticker, ts) and the time `now`, tickers whose last alert is within the
    cooldown are left out first.
    """
    least = dict(config.grades)
    if sent is not None and now is not None:
        last = sent.groupBy("ticker").agg(F.max("ts").alias("__last"))
        hours = F.make_interval(hours=F.lit(config.cooldown_hours))
        scans = scans.join(last, "ticker", "left").where(F.col("__last").isNull() | (now >= F.col("__last") + hours)).drop("__last")
    scans = scans.withColumn("price", F.coalesce("price", F.lit(0.0)))
    good = scans.where((F.col("confidence") >= config.min_confidence) & (F.col("score") >= least["C+"]))
    good = good.where((F.col("price") <= config.max_price) | (F.col("score") >= least["A+"]))
    mega = F.col("ticker").isin(*mega_caps) if mega_caps else F.lit(False)
    good = good.withColumn("mega", mega).withColumn("special", F.col("score") >= 90)
    # Mega caps alone are numbered, so ordinary tickers of a cycle are not brought together.
    turn = F.row_number().over(Window.partitionBy("cycle").orderBy("ticker"))
    first = good.where("mega").withColumn("turn", turn).where("turn = 1").drop("turn")
    return good.where("NOT mega").unionByName(first)


def cooled_down(alerts: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Alerts (ticker, ts) of which none is within the cooldown of the last one sent for its ticker.

    What was sent decides what is next, so each ticker's times are read in order; a task holds one batch and one time,
    and goes from one alert that is sent to the first one past its cooldown.
    """
    gap = np.timedelta64(config.cooldown_hours, "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ticker, last = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for name, a, b in runs_of(batch["ticker"]):
                if name != ticker:
                    ticker, last = name, None
                sent, last = jumps(batch["ts"].to_numpy()[a:b], last, gap)
                keep[a + sent] = True
            yield batch[keep]

    known = alerts.select("ticker", "ts").where(F.col("ts").isNotNull())
    return known.repartition("ticker").sortWithinPartitions("ticker", "ts").mapInPandas(run, "ticker string, ts timestamp")


def runs_of(names: pd.Series) -> Iterator[tuple[str | None, int, int]]:
    """(name, first, end) of each run of equal names; the name None is one like others."""
    codes = names.fillna("\0").to_numpy()
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    for a, b in zip(heads, np.append(heads[1:], len(codes))):
        yield codes[a], int(a), int(b)


def jumps(ts: np.ndarray, last: np.datetime64 | None, gap: np.timedelta64) -> tuple[np.ndarray, np.datetime64 | None]:
    """Which of the sorted times are sent, each at least `gap` after the one before, and the last of them."""
    sent, at = [], 0 if last is None else int(np.searchsorted(ts, last + gap))
    while at < len(ts):
        sent.append(at)
        last = ts[at]
        at = max(at + 1, int(np.searchsorted(ts, last + gap)))
    return np.array(sent, np.int64), last


def alert_history(scans: DataFrame, mega_caps: tuple[str, ...] = (), config: EngineConfig = CONFIG) -> DataFrame:
    """Every scan (ticker, cycle, ts, confidence, score, price) with its `fate`, over all cycles in order.

    A scan within the cooldown of its ticker's last alert that was sent stays silent (cooldown); others need the
    confidence, the grade, and a price under the ceiling or the best grade (confidence, grade, price); of mega caps one
    a cycle is sent, in order of tickers (throttle).  The rest is sent and begins a cooldown.

    Ordinary tickers do not touch each other and are worked off side by side.  Mega caps share a cycle's one place, so
    what one may do hangs on what the others were sent; they are one chain, read in order with one time a ticker as its
    state.  A task holds one batch of its chains.  Rows need a time; a null price counts as 0, other nulls fail.
    """
    least, gap = dict(config.grades), np.timedelta64(config.cooldown_hours, "h")
    c = F.col
    price = F.coalesce(c("price"), F.lit(0.0))
    held = F.when(~F.coalesce(c("confidence") >= config.min_confidence, F.lit(False)), "confidence").when(~F.coalesce(c("score") >= least["C+"], F.lit(False)), "grade")
    held = held.when((price > config.max_price) & (c("score") < least["A+"]), "price").otherwise("sent")
    mega = F.coalesce(c("ticker").isin(*mega_caps), F.lit(False)) if mega_caps else F.lit(False)
    rows = scans.where("ts IS NOT NULL").select("ticker", "cycle", "ts", held.alias("fate"), mega.alias("mega"), F.when(mega, "").otherwise(F.concat(F.lit("."), F.coalesce("ticker", F.lit("")))).alias("chain"))

    def ordinary(ts: np.ndarray, fate: np.ndarray, last: np.datetime64 | None) -> np.datetime64 | None:
        """Marks cooldowns in `fate`; what was sent before counts."""
        able = np.flatnonzero(fate == "sent")
        sent, newest = jumps(ts[able], last, gap)
        sent = able[sent]
        before = np.searchsorted(sent, np.arange(len(ts))) - 1  # the last one sent above each row
        times = np.append(ts[sent], np.datetime64("NaT") if last is None else last)
        quiet = ts < times[before] + gap
        quiet[sent] = False
        fate[quiet] = "cooldown"
        return newest

    def shared(rows: pd.DataFrame, fate: np.ndarray, sent: dict, taken: object) -> object:
        """The same for mega caps, row by row; `taken` is the cycle whose place is gone."""
        for i, (ticker, cycle, ts) in enumerate(zip(rows["ticker"], rows["cycle"], rows["ts"].to_numpy())):
            if ticker in sent and ts < sent[ticker] + gap:
                fate[i] = "cooldown"
            elif fate[i] == "sent":
                if cycle == taken:
                    fate[i] = "throttle"
                else:
                    taken = cycle
                    sent[ticker] = ts
        return taken

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last, sent, taken = None, None, {}, None
        for batch in batches:
            fate, ts = batch["fate"].to_numpy(object), batch["ts"].to_numpy()
            for name, a, b in runs_of(batch["chain"]):
                if name != chain:
                    chain, last, sent, taken = name, None, {}, None
                if name == "":
                    taken = shared(batch.iloc[a:b], fate[a:b], sent, taken)
                else:
                    last = ordinary(ts[a:b], fate[a:b], last)
            yield batch.assign(fate=fate)[["ticker", "cycle", "ts", "mega", "fate"]]

    kind = scans.schema["cycle"].dataType.simpleString()
    ordered = rows.repartition("chain").sortWithinPartitions("chain", "ts", "cycle", "ticker")
    return ordered.mapInPandas(run, f"ticker string, cycle {kind}, ts timestamp, mega boolean, fate string")


def tier_due(last_run: Column, now: Column, minutes: int) -> Column:
    """Whether a tier that last ran then is to run again; one that never ran is."""
    return last_run.isNull() | (now >= last_run + F.make_interval(mins=F.lit(minutes)))


def scan_universe(
    candidates: DataFrame, cap: int = 5, cycle: int | None = None, batch: int = 5, tiers: DataFrame | None = None, conservation: bool = False,
    benchmark: str = "SPY", fallback: tuple[str, ...] = ("SPY", "QQQ", "IWM"),
) -> DataFrame:
    """Symbols (symbol, priority) to scan, by least priority, then name, up to the cap.

    candidates: (symbol, priority), the small feed of a cycle.  With `cycle` they are a queue that turns by `batch`
    symbols a cycle, and `tiers`, one row (beta boolean, benchmark boolean), says which tiers are due; while
    `conservation` lasts only the candidates themselves are.  Without candidates the queue is the fallback.
    """
    spark = candidates.sparkSession
    best = candidates.groupBy("symbol").agg(F.min("priority").cast("long").alias("priority"))
    if cycle is None:
        return best.orderBy("priority", "symbol").limit(cap)
    spare = spark.createDataFrame([(s, i) for i, s in enumerate(fallback)], "symbol string, priority long")
    queue = best.unionByName(spare) if best.isEmpty() else best
    # The feed of a cycle is a few hundred symbols, so one task may number them.
    turn = Window.orderBy("priority", "symbol")
    queue = queue.withColumn("place", F.row_number().over(turn) - 1).withColumn("size", F.count("*").over(Window.partitionBy()))
    rounds = F.ceil(F.col("size") / batch)
    chosen = queue.where(F.floor(F.col("place") / batch) == F.lit(cycle) % rounds).select("symbol", (F.col("priority") + 1_000_000).alias("priority"))
    last = spark.createDataFrame([(benchmark, 2_000_000)], "symbol string, priority long")
    extra = chosen.select("*", F.lit("beta").alias("tier")).unionByName(last.select("*", F.lit("benchmark").alias("tier")))
    if conservation:
        extra = extra.limit(0)
    elif tiers is not None:
        due = tiers.select(F.explode(F.map_from_arrays(F.array(F.lit("beta"), F.lit("benchmark")), F.array("beta", "benchmark"))).alias("tier", "due"))
        extra = extra.join(F.broadcast(due.where("due")), "tier", "left_semi")
    every = best.unionByName(extra.select("symbol", "priority")).groupBy("symbol").agg(F.min("priority").alias("priority"))
    return every.orderBy("priority", "symbol").limit(cap)
