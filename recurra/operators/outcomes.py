"""What happened after the matches: statistics, distribution, failures, scenarios, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPS
from . import labels as L

RET, DD, RU, TTR = "forward_return", "max_drawdown", "max_runup", "time_to_resolution"


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def statistics(matches: DataFrame, reversal: float = -0.02, failure: float = -0.05) -> DataFrame:
    """(query_id, weighted and plain outcome statistics)."""
    ret = F.col(RET)
    wins, losses = F.sum(F.when(ret > 0, ret)), F.sum(F.when(ret < 0, ret))
    return matches.groupBy("query_id").agg(
        F.count("*").alias("n_matches"),
        (F.sum(F.col("composite") * ret) / (F.sum("composite") + EPS)).alias("weighted_return"),
        share(ret > 0).alias("continuation"),
        share(ret < reversal).alias("reversal"),
        share((F.col(DD) < failure) & (ret < 0)).alias("failure"),
        F.avg(ret).alias("mean_return"),
        F.median(ret).alias("median_return"),
        F.avg(TTR).alias("mean_resolution"),
        F.median(TTR).alias("median_resolution"),
        F.min(DD).alias("worst_drawdown"),
        F.max(RU).alias("best_runup"),
        F.stddev_pop(ret).alias("return_std"),
        (F.avg(ret) / (F.stddev_pop(ret) + EPS)).alias("sharpe"),
        share(ret > 0).alias("win_rate"),
        (F.coalesce(wins, F.lit(0.0)) / F.coalesce(F.abs(losses), F.lit(EPS))).alias("profit_factor"),
    )


def distribution(clustered: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(query_id, class shares, moments, percentiles) of matches with a cluster.

    A class has the probabilities of the clusters whose own label belongs to it.  One match alone counts as neutral
    with zeros, and moments without spread are null.
    """
    ret, name, p = F.col(RET), F.col("label"), F.col("probability")
    known = name.isin(*L.CONTINUATIONS, "full_reversal", "fake_breakout_failure")
    of = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    classes = cluster_summary(clustered, cluster).groupBy("query_id").agg(
        of(name.isin(*L.CONTINUATIONS)).alias("continuation"), of(name == "full_reversal").alias("reversal"),
        of(name == "fake_breakout_failure").alias("failure"), of(~known).alias("neutral"),
    )
    at = F.percentile(ret, F.array(*(F.lit(q) for q in (0.05, 0.25, 0.75, 0.95))))
    spread = F.stddev_pop(ret) > 0
    values = {
        "mean_return": F.avg(ret), "median_return": F.median(ret), "std_return": F.stddev_pop(ret),
        "skew": F.when(spread, F.skewness(ret)), "kurtosis": F.when(spread, F.kurtosis(ret)),
        **{f"percentile_{q}": at[i] for i, q in enumerate((5, 25, 75, 95))},
    }
    shape = clustered.groupBy("query_id").agg(F.count(ret).alias("__n"), *(F.when(F.count(ret) < 2, 0.0).otherwise(v).alias(n) for n, v in values.items()))
    names = ("continuation", "reversal", "failure", "neutral")
    shares = [F.when(F.col("__n") < 2, float(n == "neutral")).otherwise(F.col(n)).alias(n) for n in names]
    return shape.join(classes, "query_id").select("query_id", *shares, *values)


def marked(matches: DataFrame) -> DataFrame:
    """All matches with failure_type and severity, null where nothing went wrong."""
    names = {"ret": RET, "dd": DD, "ru": RU}
    kind = F.expr(L.case_sql(L.FAILURE_RULES, "NULL", **names))
    whens = " ".join(f"WHEN {L.filled(r[0], **names)} THEN least(1.0D, {L.filled(r[2], **names)})" for r in L.FAILURE_RULES)
    return matches.withColumn("failure_type", kind).withColumn("severity", F.expr(f"CASE {whens} END"))


def failure_cases(matches: DataFrame) -> DataFrame:
    """Matches that went wrong, with type and severity."""
    return marked(matches).where(F.col("failure_type").isNotNull()).withColumn("divergence_bar", F.col(TTR))


def risk_of() -> Column:
    """0 to 1, an aggregate over marked matches."""
    rate = F.count("failure_type") / F.count("*")
    spread = F.least(F.lit(1.0), F.stddev_pop(RET) / 0.1)
    risk = 0.4 * rate + 0.3 * F.coalesce(F.avg("severity"), F.lit(0.0)) + 0.3 * spread
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk))


#: What is said of a query without matches.
NO_DATA = "too few precedents for a failure analysis"


def failure_summary(matches: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rates, risk score); with `queries` one row for each of them, zeros where nothing matched."""
    found = marked(matches).groupBy("query_id").agg(
        (F.count("failure_type") / F.count("*")).alias("failure_rate"),
        F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"),
        F.coalesce(F.max("severity"), F.lit(0.0)).alias("max_severity"),
        risk_of().alias("failure_risk_score"),
        F.count("failure_type").alias("n_failure_cases"),
    )
    if queries is None:
        return found
    zeros = {n: 0.0 for n in ("failure_rate", "avg_severity", "max_severity", "failure_risk_score")}
    return queries.select("query_id").distinct().join(found, "query_id", "left").fillna(zeros | {"n_failure_cases": 0})


def failure_analysis(matches: DataFrame, queries: DataFrame, label: str = "outcome_label") -> DataFrame:
    """(query_id, rates, risk score, signals, risks) of every query; one without matches has zeros and says so."""
    none = F.array().cast("array<string>")
    found = failure_summary(matches, queries).join(warnings(matches, label), "query_id", "left")
    return found.withColumn("signals", F.coalesce("signals", F.array(F.lit(NO_DATA)))).withColumn("risks", F.coalesce("risks", none))


def normal_test(n: Column, skew: Column, kurtosis: Column) -> Column:
    """p value of the omnibus test of normality from population moments."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    first = F.asinh(F.when(y == 0, 1.0).otherwise(y) / alpha) / F.sqrt(0.5 * F.log(w2))
    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3.0) * (n + 5))
    x = (kurtosis + 3 - expected) / F.sqrt(variance)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    second = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))
    return F.exp(-(first * first + second * second) / 2)


def warnings(matches: DataFrame, label: str = "outcome_label") -> DataFrame:
    """(query_id, signals, risks): divergence signals and risk factors, in a fixed order."""
    ret = F.col(RET)
    top = F.slice(F.array_sort(F.collect_list(F.struct("rank", RET))), 1, 5)
    by_label = matches.groupBy("query_id", label).agg(F.count("*").alias("m")).groupBy("query_id").agg(F.count("*").alias("clusters"), F.max("m").alias("largest"))
    by_ticker = matches.groupBy("query_id", "ticker").agg(F.avg(RET).alias("m")).groupBy("query_id").agg(
        F.count("*").alias("tickers"), F.max("m").alias("best"), F.min("m").alias("worst")
    )
    whole = matches.groupBy("query_id").agg(
        F.count("*").alias("n"), F.stddev_pop(ret).alias("sd"), F.skewness(ret).alias("g1"), F.kurtosis(ret).alias("g2"),
        share((F.col(DD) < -0.03) & (ret > 0)).alias("rescued"), top.alias("top"),
    )
    d = whole.join(by_label, "query_id").join(by_ticker, "query_id")
    usable = (F.col("n") >= 10) & (F.col("sd") > 0)
    n = F.when(usable, F.col("n").cast("double"))
    rules = (
        ("signals", "return distribution is not normal", usable & (normal_test(n, F.col("g1"), F.col("g2")) < 0.05)),
        ("signals", "outcomes are widely spread", F.col("sd") > 0.08),
        ("signals", "no outcome prevails", (F.col("clusters") >= 2) & (F.col("largest") / F.col("n") < 0.4)),
        ("signals", "gains came after drawdowns", F.col("rescued") > 0.3),
        ("risks", "left-skewed returns", (F.col("n") >= 5) & (F.col("g1") < -0.5)),
        ("risks", "best matches lost", F.size(F.filter("top", lambda t: t[RET] < -0.03)) >= 3),
        ("risks", "instruments disagree", (F.col("tickers") > 1) & (F.col("best") > 0.03) & (F.col("worst") < -0.03)),
    )
    found = {k: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), text) for g, text, c in rules if g == k)), lambda x: x.isNotNull()) for k in ("signals", "risks")}
    return d.select("query_id", found["signals"].alias("signals"), found["risks"].alias("risks"))


def cluster_summary(matches: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(query_id, cluster, members, probability, averages, label), scenarios' range and confidence included."""
    n = F.count("*")
    whole = matches.groupBy("query_id").agg(n.alias("total"))
    p = F.percentile(RET, F.array(F.lit(0.1), F.lit(0.9)))
    found = matches.groupBy("query_id", cluster).agg(
        n.alias("n_members"), F.avg(RET).alias("avg_return"), F.avg(DD).alias("avg_drawdown"), F.avg(RU).alias("avg_runup"),
        F.avg(TTR).alias("avg_time_to_resolution"), p[0].alias("return_low"), p[1].alias("return_high"),
    )
    probability = F.col("n_members") / F.col("total")
    return found.join(whole, "query_id").select(
        "query_id", cluster, "n_members", probability.alias("probability"), "avg_return", "avg_drawdown", "avg_runup", "avg_time_to_resolution",
        "return_low", "return_high", F.least(F.lit(1.0), probability * F.col("n_members") / 5).alias("confidence"),
        L.cluster_label("avg_return", "avg_drawdown", "avg_runup").alias("label"),
    )


def groups_of(points: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> np.ndarray:
    """k-means with spread-out seeds, the best of several starts."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(points), int))
    for _ in range(starts):
        centres = points[[rng.integers(len(points))]]
        while len(centres) < k:
            gap = ((points[:, None] - centres) ** 2).sum(2).min(1)
            weight = gap / gap.sum() if gap.sum() > 0 else None
            centres = np.vstack([centres, points[rng.choice(len(points), p=weight)]])
        for _ in range(100):
            own = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
            moved = np.array([points[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = ((points - centres[own]) ** 2).sum()
        if cost < best[0] - 1e-12:
            best = (cost, own)
    return best[1]


def merged_groups(points: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative clustering that adds the least variance with each merge.

    Of equal costs the pair with the earliest first members is merged: groups stay in the order of their first point,
    and a merged one takes the earlier place.  Groups are numbered in that order.
    """
    means, sizes = points.copy(), np.ones(len(points))
    members = [[i] for i in range(len(points))]
    while len(members) > k:
        gap = means[:, None] - means
        square = np.zeros(gap.shape[:2])
        for d in range(points.shape[1]):  # one after the other, so that sums are those of any engine that adds in order
            square = square + gap[:, :, d] * gap[:, :, d]
        cost = square * (sizes[:, None] * sizes / (sizes[:, None] + sizes))
        cost[np.tril_indices(len(members))] = np.inf
        i, j = divmod(int(cost.argmin()), len(members))
        means[i] = (means[i] * sizes[i] + means[j] * sizes[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        members[i] += members.pop(j)
        means, sizes = np.delete(means, j, 0), np.delete(sizes, j)
    own = np.zeros(len(points), int)
    for j, m in enumerate(members):
        own[m] = j
    return own


#: Standardised outcomes are rounded to so many places before they are merged, so that ties are ties in any engine.
TIE_PLACES = 9


def clustered(matches: DataFrame, clusters: int = 5, least: int = 3, method: str = "kmeans") -> DataFrame:
    """Matches with a cluster_id; a query's matches are few (its top_n), so one task has them all."""
    if method not in ("kmeans", "hierarchical"):
        raise ValueError("kmeans or hierarchical")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema.fields) + ", cluster_id int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        n = len(rows)
        if n < least:
            return rows.assign(cluster_id=0)
        points = rows[[RET, DD, RU, TTR]].to_numpy(float)
        spread = points.std(0)
        points = (points - points.mean(0)) / np.where(spread > 0, spread, 1)
        k = min(n, max(2, min(clusters, n // 3)))
        return rows.assign(cluster_id=groups_of(points, k) if method == "kmeans" else merged_groups(points.round(TIE_PLACES), k))

    # Rows are few and groups dear, so sizes must not bring the groups together in one task.
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return matches.repartition(parts, "query_id").groupBy("query_id").applyInPandas(run, schema)
