"""The fingerprint of a window: nine groups of numbers from one grouped pass.

`prepared` adds the per-bar columns once; each group is then a set of
aggregates over (ticker, timeframe, k), so any choice of groups is one shuffle.
Below a group's least length its numbers are 0, as are those that are not finite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS
from .windows import KEY

LOOKBACKS = (5, 10, 20)
HALF = 1 << 31  # half a window, on the scale that its bars are ordered by


def prepared(windows: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, halves: bool = True) -> DataFrame:
    """Bars of windows (no future bars; n of them, counted here if that isn't said) with returns, true ranges and rolling statistics; with `halves`, late bars with their partners.

    `place` orders bars as `i` does, and a late bar's partner in the early half stands exactly HALF before it. So one sort
    serves all windows here, and it has the bars before any column is added to them.
    """
    whole = Window.partitionBy(*KEY)
    order = whole.orderBy("place" if halves else "i")
    frame = lambda n: order.rowsBetween(1 - n, 0)
    c, before = F.col("close"), F.col("before")
    lagged = lambda x: F.col(x) - F.lag(x).over(order)
    counted = windows if "n" in windows.columns else windows.withColumn("n", F.count("*").over(whole))
    d = counted.withColumn("place", F.expr(f"i * {HALF}L div greatest(n div 2, 1)")).withColumn("before", F.lag("close").over(order))
    d = d.withColumn("mid", F.floor(F.col("n") / 2)).withColumn("early", F.col("i") < F.col("mid")).withColumn("dc", c - before)
    d = d.withColumn("r", F.log(F.greatest(c, F.lit(1e-10))) - F.log(F.greatest(before, F.lit(1e-10))))
    d = d.withColumn("tr", F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))))
    rolled = {"a5": F.when(F.col("i") >= 5, F.avg("tr").over(frame(5)))}
    rolled["bw"] = F.when(F.col("i") >= 19, F.stddev_samp("close").over(frame(20)) / (F.abs(F.avg("close").over(frame(20))) + EPS))
    for n in lookbacks:
        rolled[f"sd{n}"] = F.when(F.col("i") >= n, F.stddev_samp("r").over(frame(n)))
        rolled[f"m{n}"] = F.when(F.col("i") >= n, F.avg("r").over(frame(n)))
    late = (~F.col("early")) & (F.col("i") < 2 * F.col("mid"))
    partner = F.max(F.when(F.col("early"), c)).over(order.rangeBetween(-HALF, -HALF))
    d = d.withColumns(rolled | ({"late": late, "pair": F.when(late, partner)} if halves else {}))
    steps = {f"dsd{n}": lagged(f"sd{n}") for n in lookbacks} | {f"acc{n}": lagged(f"m{n}") for n in lookbacks}
    d = d.withColumns(steps | {"da5": lagged("a5")}).withColumns({f"jerk{n}": lagged(f"acc{n}") for n in lookbacks})
    low, high = F.min("close").over(whole), F.max("close").over(whole)
    x = F.col("i") - (F.col("n") - 1) / 2.0
    return d.withColumns({
        "nc": (c - low) / (high - low + EPS), "nv": F.col("volume") / (F.avg("volume").over(whole) + EPS),
        "top": F.max(F.when(F.col("early"), F.col("high"))).over(whole), "bottom": F.min(F.when(F.col("early"), F.col("low"))).over(whole),
        "final": F.max(F.when(F.col("i") == F.col("n") - 1, c)).over(whole),
        "q": x * x - (F.col("n") * F.col("n") - 1) / 12.0,
    })


def at_least(condition: Column, x: Column) -> Column:
    """x where the group is long enough and x is finite, else 0."""
    # NaN is greater than infinity in Spark, so one comparison leaves out nulls, NaN and both infinities.
    return F.when(condition & (F.abs(x) < float("inf")), x).otherwise(0.0)


def last(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("i")))


def first(name: str) -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("i")))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, 0 for a constant side; both null where one is."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def fit_quality(y: str) -> Column:
    return F.when(F.stddev_pop(y) == 0, 0.0).otherwise(F.regr_r2(F.col(y), F.col("i")))


N = F.max


def volatility() -> dict[str, Column]:
    out = {}
    for n in LOOKBACKS:
        sd, enough = f"sd{n}", F.count(f"sd{n}") >= 2
        out[f"vol_z_{n}"] = at_least(enough, (last(sd) - F.avg(sd)) / (F.stddev_pop(sd) + EPS))
        out[f"vol_slope_{n}"] = at_least(enough, F.regr_slope(F.col(sd), F.col("i")) / (F.avg(sd) + EPS))
        out[f"vol_of_vol_{n}"] = at_least(enough, F.stddev_pop(f"dsd{n}") / (F.avg(sd) + EPS))
    return out


def compression() -> dict[str, Column]:
    enough = F.count("tr") >= 10
    down, up = F.count_if(F.col("da5") < 0), F.count_if(F.col("da5") > 0)
    recent = F.avg(F.when(F.col("i") >= F.col("n") - 10, F.col("tr")))
    return {
        "atr_ratio": at_least(enough, recent / (F.avg("tr") + EPS)),
        "compression_ratio": at_least(enough, down / (down + up + EPS)),
        "expansion_ratio": at_least(enough, up / (down + up + EPS)),
        "bw_current": at_least(enough, last("bw")),
        "bw_slope": at_least(enough, (last("bw") - first("bw")) / (F.count("bw") + EPS)),
        "compression_bars": at_least(enough, down.cast("double")),
    }


def direction() -> dict[str, Column]:
    enough, y, i = N("n") >= 5, F.col("nc"), F.col("i")
    slope = F.regr_slope(y, i)
    return {
        "slope": at_least(enough, slope),
        "r2": at_least(enough, fit_quality("nc")),
        "curvature": at_least(enough, F.sum(F.col("q") * y) / F.sum(F.col("q") * F.col("q"))),
        "endpoint_dev": at_least(enough, last("nc") - (slope * (N("n") - 1) + F.regr_intercept(y, i))),
    }


def momentum() -> dict[str, Column]:
    out = {}
    for n in LOOKBACKS:
        acc, enough = f"acc{n}", N("n") - 1 >= n + 2
        out[f"mean_accel_{n}"] = at_least(enough, F.avg(acc))
        out[f"accel_trend_{n}"] = at_least(enough, (last(acc) - first(acc)) / (F.count(acc) + EPS))
        out[f"mean_jerk_{n}"] = at_least(enough, F.avg(f"jerk{n}"))
    return out


def volume() -> dict[str, Column]:
    enough, size = (N("n") >= 10) & (F.sum("volume") != 0), N("n")
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("nv")))
    ends = F.max(F.when(F.col("i") == F.col("n") - 1, F.col("nv"))) - F.max(F.when(F.col("i") == F.col("n") - 2, F.col("nv")))
    tail = F.sum(F.when(F.col("i") >= F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 5)), F.col("nv")))
    return {
        "volume_slope": at_least(enough, F.regr_slope(F.col("nv"), F.col("i"))),
        "volume_r2": at_least(enough, fit_quality("nv")),
        "volume_accel": at_least(enough, F.try_divide(ends - (at(1) - at(0)), size - 2)),
        "pv_corr": at_least(enough, correlation(F.abs("r"), F.col("volume"))),
        "volume_z": at_least(enough, (last("nv") - 1) / (F.stddev_pop("nv") + EPS)),
        "concentration": at_least(enough, tail / (F.sum("nv") + EPS)),
    }


def symmetry() -> dict[str, Column]:
    enough, c = N("n") >= 6, F.col("close")
    half = {True: F.col("early"), False: F.col("late")}
    spread = {k: F.max(F.when(h, c)) - F.min(F.when(h, c)) for k, h in half.items()}
    inside = {True: F.col("early") & (F.col("i") > 0), False: F.col("late") & (F.col("i") > F.col("mid"))}
    noise = {k: F.stddev_pop(F.when(h, F.col("dc"))) for k, h in inside.items()}
    slope = {k: (F.max_by(c, F.when(h, F.col("i"))) - F.min_by(c, F.when(h, F.col("i")))) / (N("mid") + EPS) for k, h in half.items()}
    flat = (F.abs(slope[True]) < 1e-12) | (F.abs(slope[False]) < 1e-12)
    return {
        "range_ratio": at_least(enough, spread[False] / (spread[True] + EPS)),
        "vol_ratio": at_least(enough, noise[False] / (noise[True] + EPS)),
        "dir_symmetry": at_least(enough, F.when(flat, 0.0).otherwise(F.signum(slope[True]) * F.signum(slope[False]))),
        "half_corr": at_least(enough, correlation(F.col("pair"), F.when(F.col("late"), c))),
    }


def breakout() -> dict[str, Column]:
    enough, c = N("n") >= 10, F.col("close")
    after = ~F.col("early")
    up, down = F.count_if(after & (c > F.col("top"))), F.count_if(after & (c < F.col("bottom")))
    rest, top, bottom, final = N("n") - N("mid") + EPS, N("top"), N("bottom"), N("final")
    size = top - bottom + EPS
    score = F.when(((up > 0) | (down > 0)) & final.between(bottom, top), 1.0).when((up > 0) & (final < top), 0.5)
    score = score.when((down > 0) & (final > bottom), 0.5).otherwise(0.0)
    return {
        "upside_ratio": at_least(enough, up / rest),
        "downside_ratio": at_least(enough, down / rest),
        "failed_score": at_least(enough, score),
        "max_up_exc": at_least(enough, F.greatest(F.lit(0.0), (F.max(F.when(after, F.col("high"))) - top) / size)),
        "max_dn_exc": at_least(enough, F.greatest(F.lit(0.0), (bottom - F.min(F.when(after, F.col("low")))) / size)),
    }


def position() -> dict[str, Column]:
    enough, c, final = N("n") >= 2, F.col("close"), N("final")
    size = F.max("high") - F.min("low") + EPS
    mean = F.sum(c * F.col("volume")) / (F.sum("volume") + EPS)
    below, upto = F.count_if(c < F.col("final")), F.count_if(c <= F.col("final"))
    return {
        "position": at_least(enough, (final - F.min("low")) / size),
        "vwap_distance": at_least(enough, (final - mean) / size),
        "percentile": at_least(enough, (below + upto + 1) * 50 / N("n") / 100),
        "mean_rev_z": at_least(enough, (final - F.avg(c)) / (F.stddev_pop(c) + EPS)),
    }


def cycle(start: str = "2021-01-27", days: float = 147.0) -> dict[str, Column]:
    since = (F.unix_micros(F.max("ts")) - F.unix_micros(F.to_timestamp(F.lit(start)))) / 86_400e6
    phase = since * (2 * F.pi()) / days
    return {"cycle_sin": F.coalesce(F.sin(phase), F.lit(0.0)), "cycle_cos": F.coalesce(F.cos(phase), F.lit(0.0))}


GROUPS = {
    "volatility": volatility, "compression": compression, "direction": direction, "momentum": momentum, "volume": volume,
    "symmetry": symmetry, "breakout": breakout, "position": position, "cycle": cycle,
}


def features(windows: DataFrame, groups: tuple[str, ...] = tuple(GROUPS), window: int = 60) -> DataFrame:
    """(ticker, timeframe, k, features...) of each window."""
    chosen = reduce(lambda a, b: a | b, (GROUPS[g]() for g in groups))
    past = windows.where(F.col("i") < window)
    past = past.withColumn("n", F.least("n", F.lit(window))) if "n" in past.columns else past
    return prepared(past, halves="symmetry" in groups).groupBy(*KEY).agg(*(x.alias(name) for name, x in chosen.items()))


def fingerprint(windows: DataFrame, window: int = 60) -> DataFrame:
    """(ticker, timeframe, k, vector): all features in order, and the columns that profiles need."""
    found = features(windows, window=window)
    names = [c for c in found.columns if c not in KEY]
    return found.select(*KEY, F.array(*names).alias("vector"), "vol_z_5", "mean_accel_5", "volume_slope", "concentration")


def time_warp(windows: DataFrame, length: int = 100, window: int = 60) -> DataFrame:
    """Windows resampled to `length` equispaced bars by linear interpolation; times are dropped."""
    values = ("open", "high", "low", "close", "volume")
    rows = windows.where(F.col("i") < window).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", *values))).alias("b"))
    n = F.size("b")
    rows = rows.select(*KEY, "b", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    place = F.col("i") * (F.col("n") - 1) / F.lit(length - 1)
    rows = rows.withColumn("p", place).withColumn("lo", F.least(F.floor("p").cast("int"), F.col("n") - 2))
    at = lambda c, j: F.get(F.col("b"), j)[c]
    lo = F.greatest(F.col("lo"), F.lit(0))
    blend = lambda c: F.coalesce(at(c, lo) + (at(c, lo + 1) - at(c, lo)) * (F.col("p") - lo), at(c, lo))
    return rows.select(*KEY, "i", *(blend(c).alias(c) for c in values))
