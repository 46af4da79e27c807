"""The fixed chains: ingest bars into the store, scan the newest window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import records
from ..operators import features, labels, outcomes, projection, signals, similarity
from ..operators.windows import KEY, forward_outcomes, latest_window, rolling_windows
from ..sources import store
from ..sources.folders import settled


def patterns_of(bars: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Windows with outcome, label, fingerprint and profiles."""
    windows = rolling_windows(bars, config.window, config.horizon, config.stride)
    found = forward_outcomes(windows, config.window).withColumn("outcome_label", labels.outcome_label())
    prints = features.fingerprint(windows, config.window)
    marks = labels.profiles(*(F.col(c) for c in ("vol_z_5", "mean_accel_5", "volume_slope", "concentration")))
    prints = prints.select(*KEY, "vector", *marks)
    found = found.join(prints, list(KEY)).withColumn("window_size", F.lit(config.window))
    return store.with_ids(found)


def ingest(bars: DataFrame, path: str, config: EngineConfig = EngineConfig()) -> int:
    """Bars to stored patterns; how many were written.  An id depends on a pattern's key, so what is ingested twice is read once."""
    return store.store(patterns_of(bars, config), path)


def matches_of(bars: DataFrame, patterns: DataFrame, config: EngineConfig = EngineConfig(), cross_asset: bool = True) -> DataFrame:
    """The best stored patterns for the newest window of each series, re-ranked; query_id is the ticker."""
    return matches_of_windows(latest_window(bars, config.window), patterns, config, cross_asset)


def matches_of_windows(newest: DataFrame, patterns: DataFrame, config: EngineConfig = EngineConfig(), cross_asset: bool = True) -> DataFrame:
    """The same for windows (ticker, timeframe, k, i, bar) that are at hand, one of each ticker."""
    newest = features.fingerprint(newest, config.window)
    queries = newest.select(F.col("ticker").alias("query_id"), F.col("ticker").alias("q_ticker"), F.col("vector").alias("q_vector"))
    found = similarity.find_matches(patterns, queries, config.top_n, config.min_similarity, cross_asset, config.weights)
    return similarity.rerank(found)


#: What a result keeps of a match.
MATCH_FIELDS = ("rank", "pattern_id", "ticker", "start_time", "composite", "cosine", "euclidean", "dtw", "forward_return", "max_drawdown", "max_runup", "time_to_resolution", "outcome_label")


def echoes(newest: DataFrame, patterns: DataFrame, config: EngineConfig = EngineConfig(), cross_asset: bool = True) -> DataFrame:
    """One result per window: its matches, re-ranked, as an array, with confidence and type; windows without matches too.

    A series has at most top_n matches, which one aggregate gathers and sums up.
    """
    top = lambda f, name: f(F.when(F.col("rank") <= 10, F.col(name)))
    match = F.struct(*MATCH_FIELDS)
    found = matches_of_windows(newest, patterns, config, cross_asset).groupBy("query_id").agg(
        F.array_sort(F.collect_list(match)).alias("matches"), F.count("*").cast("int").alias("n_matches"), F.min_by("composite", "rank").alias("similarity"),
        similarity.confidence_of().alias("confidence"), F.avg("forward_return").alias("mean_return"), F.avg("max_drawdown").alias("mean_drawdown"),
        top(F.avg, "forward_return").alias("r"), top(F.avg, "max_drawdown").alias("d"), top(F.stddev_pop, "forward_return").alias("s"),
    )
    whole = newest.groupBy("ticker", "timeframe").agg(F.max("ts").alias("as_of"))
    rows = whole.join(found, F.col("ticker") == F.col("query_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select(
        "ticker", "timeframe", "as_of", F.lit(config.window).alias("window_size"), labels.echo_type("r", "d", "s").alias("echo_type"), zero("similarity"), zero("confidence"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "mean_return", "mean_drawdown", F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)).alias("matches"),
    )


def scan(bars: DataFrame, patterns: DataFrame, as_of: Column | None = None, config: EngineConfig = EngineConfig(), timeframe: str = "1h", cross_asset: bool = True) -> DataFrame:
    """One row per series whose newest window could be taken: how it went before, whatever was found.

    Matches are re-ranked, clustered and summed up: statistics, the distribution by clusters, failures with their
    signals, scenarios and the projection, and the score with its grade.  `as_of` is the time of the score, by default
    that of the last bar.
    """
    # top_n rows a series, which a dozen aggregates read.
    matches = settled(matches_of(bars, patterns, config, cross_asset), "matches")
    last = latest_window(bars, config.window).groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    queries = last.select(F.col("ticker").alias("query_id"), F.col("ticker").alias("q_ticker"), "last_ts")
    price = matches.groupBy("query_id").agg(F.min_by("last_close", "rank").alias("price"))
    found = projection.projections(matches, queries.select("query_id", "q_ticker"), timeframe, config.clusters)
    found = found.join(queries.select("query_id", "last_ts"), "query_id").join(price, "query_id", "left")
    day = signals.cycle_day(F.col("last_ts") if as_of is None else as_of, config)
    score = signals.score(F.col("similarity"), F.col("mean_return"), F.col("return_std"), F.col("primary.probability"), day, F.col("confidence"), config)
    usable = F.coalesce((F.col("n_matches") > 0) & (F.col("confidence") > 0), F.lit(False))
    found = found.withColumn("score", F.when(usable, score).otherwise(0.0))
    return found.withColumn("grade", F.when(usable, signals.grade(F.col("score"), config)).otherwise("F"))


def scan_records(bars: DataFrame, patterns: DataFrame, config: EngineConfig = EngineConfig(), timeframe: str = "1h", cross_asset: bool = True, method: str = "kmeans") -> DataFrame:
    """(ticker, found, record): a scan's whole answer for each series as a JSON record, and the numbers before they were rounded.

    A series has at most top_n matches, five clusters and five failure cases, which are gathered in order.
    """
    matches = settled(matches_of(bars, patterns, config, cross_asset), "matches")
    last = latest_window(bars, config.window).groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    queries = last.select(F.col("ticker").alias("query_id"), F.col("ticker").alias("q_ticker"))
    held = settled(outcomes.clustered(matches, config.clusters, method=method), "clustered")
    best = matches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*MATCH_FIELDS, "end_time"))).alias("matches"))
    summary = outcomes.cluster_summary(held)
    entry = F.struct((-F.col("probability")).alias("order"), "cluster_id", F.struct(*(c for c in summary.columns if c != "query_id")).alias("c"))
    groups = summary.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("clusters"))
    worst = F.struct((-F.col("severity")).alias("order"), "rank", F.struct("ticker", "failure_type", "severity", "divergence_bar").alias("c"))
    cases = outcomes.failure_cases(matches).groupBy("query_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(worst)), 1, 5), lambda e: e["c"]).alias("cases"))
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    failures = outcomes.failure_analysis(held, queries, "cluster_id").join(cases, "query_id", "left").withColumn("cases", none(cases, "cases"))
    failures = failures.select("query_id", F.struct(*(c for c in failures.columns if c != "query_id")).alias("failures"))
    found = projection.projections_of(held, queries, timeframe, config.clusters).join(failures, "query_id").join(best, "query_id", "left").join(groups, "query_id", "left")
    found = found.withColumns({"matches": none(best, "matches"), "clusters": none(groups, "clusters"), "projection": F.struct("primary", "alternatives", "overall_confidence", "time_horizon", "narrative")})
    found = found.select(F.col("q_ticker").alias("ticker"), "timeframe", F.lit(config.window).alias("window_size"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "echo_type", "confidence", "n_matches", "matches", "distribution", "clusters", "failures", "projection")
    return found.select("ticker", F.struct(*found.columns).alias("found"), records.as_json(records.SCAN).alias("record"))
