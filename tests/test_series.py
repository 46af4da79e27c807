"""Windows, outcomes and fingerprints against numpy, degenerate input, and the scan chain."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recurra import config
from recurra.config import EngineConfig, stride
from recurra.functions import series
from recurra.operators import encoder, features, labels, normalize, outcomes, projection, reduction, signals, similarity, warping
from recurra.operators import windows as W
from recurra.plans import scan as plans
from recurra.sources import bars as B
from recurra.sources import store


def frame(spark, close, ticker="T", volume=None):
    rng = np.random.default_rng(1)
    close = np.asarray(close, float)
    volume = rng.lognormal(3, 0.5, len(close)) if volume is None else volume
    start = dt.datetime(2024, 1, 1)
    rows = [(ticker, "1h", start + dt.timedelta(hours=i), float(c), float(c * 1.01), float(c * 0.99), float(c), float(v)) for i, (c, v) in enumerate(zip(close, volume))]
    return spark.createDataFrame(rows, "ticker string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(n, seed=0):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.001, 0.02, n)))


def test_windows_and_outcomes(spark):
    close = walk(200)
    found = W.forward_outcomes(W.rolling_windows(frame(spark, close))).orderBy("k").collect()
    assert len(found) == (200 - 80) // 30 + 1
    for r in found:
        e, after = close[r.k * 30 + 59], close[r.k * 30 + 60 : r.k * 30 + 80]
        moves = after / e - 1
        assert r.forward_return == pytest.approx(moves[-1])
        assert r.max_drawdown == pytest.approx(moves.min()) and r.max_runup == pytest.approx(moves.max())
        assert r.time_to_resolution == np.argmax(np.abs(moves)) + 1


def test_short_series_have_no_windows(spark):
    assert W.rolling_windows(frame(spark, walk(79))).count() == 0
    assert W.latest_window(frame(spark, walk(30))).count() == 0
    assert W.latest_window(frame(spark, walk(70))).count() == 60


def test_ties_and_zero_entry(spark):
    close = np.r_[np.full(60, 10.0), [11, 9, 11], np.full(17, 10.0)]
    assert W.forward_outcomes(W.rolling_windows(frame(spark, close))).first().time_to_resolution == 1
    close[59] = 0.0
    assert W.forward_outcomes(W.rolling_windows(frame(spark, close))).first().forward_return > 1e8


def test_stride_truncates_the_float_product():
    assert stride(60, 0.9) == 5 and stride(60, 0.5) == 30
    with pytest.raises(ValueError):
        EngineConfig(window=10)


def test_features_against_numpy(spark):
    close = walk(80, 3)
    got = features.features(W.rolling_windows(frame(spark, close))).first().asDict()
    c = close[:60]
    r = np.diff(np.log(c))
    sd = np.array([r[i - 9 : i + 1].std(ddof=1) for i in range(9, 59)])
    assert got["vol_z_10"] == pytest.approx((sd[-1] - sd.mean()) / (sd.std() + 1e-10))
    n = (c - c.min()) / (np.ptp(c) + 1e-10)
    assert got["curvature"] == pytest.approx(np.polyfit(np.arange(60), n, 2)[0], rel=1e-6)
    assert got["slope"] == pytest.approx(np.polyfit(np.arange(60), n, 1)[0])
    assert got["half_corr"] == pytest.approx(np.corrcoef(c[:30], c[30:])[0, 1])
    assert got["mean_rev_z"] == pytest.approx((c[-1] - c.mean()) / (c.std() + 1e-10))


@pytest.mark.parametrize("close, volume", [(np.full(80, 5.0), None), (walk(80), np.zeros(80)), (walk(80), np.full(80, 3.0))])
def test_degenerate_windows_are_finite(spark, close, volume):
    vector = features.fingerprint(W.rolling_windows(frame(spark, close, volume=volume))).first().vector
    assert len(vector) == 49 and np.isfinite(vector).all()


@pytest.mark.parametrize("n", [2, 4, 5, 6, 9, 10, 11, 19, 20, 21])
def test_features_at_their_least_lengths(spark, n):
    rows = frame(spark, walk(n)).withColumn("k", F.lit(0)).withColumn("i", F.row_number().over(W.Window.partitionBy("ticker").orderBy("ts")) - 1)
    vector = features.fingerprint(rows, window=n).first().vector
    assert np.isfinite(vector).all()


def test_warp_keeps_ends_and_length(spark):
    found = features.time_warp(W.rolling_windows(frame(spark, walk(80)))).orderBy("i").collect()
    assert len(found) == 100 and found[0].close == pytest.approx(walk(80)[0]) and found[-1].close == pytest.approx(walk(80)[59])


def vectors(spark, x, tickers="ABCD"):
    rows = [(i, tickers[i % len(tickers)], [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "pattern_id long, ticker string, vector array<double>")


def asked(df):
    return df.selectExpr("pattern_id AS query_id", "ticker AS q_ticker", "vector AS q_vector")


def test_normalisers(spark):
    x = np.random.default_rng(0).normal(size=(50, 6))
    value = {m: np.array([r.vector for r in normalize.normalised(vectors(spark, x), m).collect()]) for m in normalize.METHODS}
    assert np.abs(value["zscore"].mean(0)).max() < 1e-9
    assert value["minmax"].min() >= 0 and value["minmax"].max() <= 1
    assert 0 < value["combined"].min() and value["combined"].max() < 1
    assert 0 < value["rank"].min() and value["rank"].max() < 1


def test_ranks_are_those_of_one_sort(spark):
    x = np.round(np.random.default_rng(0).normal(size=(300, 3)), 1)
    x[:, 2] = 1.0
    got = {r.pattern_id: r.vector for r in normalize.normalised(vectors(spark, x), "rank").collect()}
    for i, row in enumerate(x):
        want = [((x[:, d] < v).sum() + ((x[:, d] == v).sum() + 1) / 2) / 301 for d, v in enumerate(row)]
        assert got[i] == pytest.approx(want)
    assert normalize.normalised(vectors(spark, x).where("false"), "rank").count() == 0


def test_queries_beyond_one_block_are_all_answered(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    p = vectors(spark, x)
    whole, parts = (similarity.paired(p, asked(p), block).select("query_id", "pattern_id").collect() for block in (30, 7))
    assert len(parts) == 900 and sorted(whole) == sorted(parts)


def test_matching(spark):
    x = np.random.default_rng(0).normal(size=(40, 42))
    p = vectors(spark, x)
    found = similarity.find_matches(p, asked(p.where("pattern_id = 3")), 5, 0.1).orderBy("rank").collect()
    assert found[0].pattern_id == 3 and found[0].composite == pytest.approx(1.0, abs=1e-6)
    assert [r.composite for r in found] == sorted((r.composite for r in found), reverse=True) and len(found) <= 5
    same = similarity.find_matches(p, asked(p.where("pattern_id = 3")), 50, -1.0, cross_asset=False).select("ticker").distinct().collect()
    assert [r.ticker for r in same] == ["D"]
    zero = similarity.scored(vectors(spark, [np.zeros(3)]), asked(vectors(spark, [np.ones(3)]))).first()
    assert zero.cosine == 0.0


def test_series_likeness():
    t = np.linspace(0, 6, 50)
    alone = lambda rule, a, b: float(rule(a[None], b[None])[0])
    assert alone(series.best_lag, np.sin(t), np.sin(t + 0.1)) > 0.5
    assert alone(series.warped_likeness, t, t) == pytest.approx(1.0)
    assert alone(series.warped_likeness, t, t[:0]) == 0.0
    x, y = np.random.default_rng(3).normal(size=(2, 30, 17))
    lags = [np.correlate(*((v - v.mean()) / v.std() for v in p), "full").max() / 17 for p in zip(x, y)]
    assert series.best_lag(x, y) == pytest.approx(np.clip(lags, 0, 1))
    mixed = series.batched(series.best_lag, pd.Series([x[0], None, x[1][:5]]), pd.Series([y[0], y[1], y[1]]))
    assert mixed[0] == pytest.approx(lags[0]) and pd.isna(mixed[1]) and 0 <= mixed[2] <= 1
    a, b = np.random.default_rng(0).normal(size=(2, 12))
    a, b = ((v - v.mean()) / (v.std() + 1e-10) for v in (a, b[:9]))
    d = np.full((13, 10), np.inf)
    d[0, 0] = 0
    for i in range(1, 13):
        for j in range(1, 10):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    both = series.warped_likeness(np.stack([a, a]), np.stack([b, b]))
    assert both == pytest.approx(np.full(2, np.exp(-np.sqrt(d[12, 9]) / 12)), rel=1e-6)


def test_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, "AB"[i % 2], 0.9 - i / 100, i + 1, float(a), float(b), float(abs(a)), int(5 + i % 3), "mixed_regime") for i, (a, b) in enumerate(rng.normal(0, 0.05, (20, 2)))]
    rows += [(2, 0, "A", 0.8, 1, 0.1, -0.01, 0.1, 3, "mixed_regime")]
    m = spark.createDataFrame(rows, "query_id long, pattern_id long, ticker string, composite double, rank int, forward_return double, max_drawdown double, max_runup double, time_to_resolution int, outcome_label string")
    for method in ("kmeans", "hierarchical"):
        found = outcomes.cluster_summary(outcomes.clustered(m, method=method)).groupBy("query_id").agg(F.sum("probability").alias("p"), F.count("*").alias("n")).collect()
        assert {r.query_id: round(r.p, 9) for r in found} == {1: 1.0, 2: 1.0}
        assert {r.query_id: r.n for r in found}[1] <= 5
    assert all(0 <= r.failure_risk_score <= 1 for r in outcomes.failure_summary(m).collect())
    parts = {r.query_id: r for r in outcomes.distribution(outcomes.clustered(m)).collect()}
    assert sum((parts[1].continuation, parts[1].reversal, parts[1].failure, parts[1].neutral)) == pytest.approx(1.0)
    alone = parts[2]
    assert (alone.skew, alone.neutral, alone.mean_return) == (0.0, 1.0, 0.0)
    asked = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "query_id long, q_ticker string")
    found = projection.projections(m, asked)
    by_id = {r.query_id: r for r in found.collect()}
    assert by_id[3].primary.label == "insufficient_data" and by_id[3].overall_confidence == 0 and "No precedents for C" in by_id[3].narrative
    assert by_id[1].primary.probability == max(s.probability for s in [by_id[1].primary, *by_id[1].alternatives])
    assert by_id[1].narrative.startswith("A on 1h") and not by_id[2].alternatives and by_id[2].primary.resolution == "3 bars"
    cards = {r.query_id: r for r in signals.trade_cards(found.withColumn("price", F.lit(10.0)), F.lit(dt.datetime(2024, 2, 1))).collect()}
    assert cards[3].grade == "F" and "No usable data: C" in cards[3].card and json.loads(cards[1].card)["rank"] == "ALPHA"
    assert json.loads(cards[2].card)["directives"]["target"] == pytest.approx(11.0)


def test_reduction_is_that_of_singular_vectors(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)) * [5, 4, 3, 2, 1] + 7
    table = vectors(spark, x)
    got = np.array([r.vector for r in reduction.reduced(table, reduction.fit(table, 3)).orderBy("pattern_id").collect()])
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
    v = v * np.sign(v[np.arange(3), np.abs(v).argmax(1)])[:, None]
    assert got == pytest.approx((x - x.mean(0)) @ v.T)
    with pytest.raises(ValueError):
        reduction.fit(table, 6)


def test_normal_test_against_known_values(spark):
    x = np.arange(20.0)
    z = (x - x.mean()) / x.std()
    row = spark.range(1).select(outcomes.normal_test(F.lit(20.0), F.lit(float((z**3).mean())), F.lit(float((z**4).mean() - 3))).alias("p")).first()
    assert 0 < row.p < 1


def test_cooldown_and_gate(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(hours=h)) for h in (0, 3, 8, 9, 15, 16)]
    got = [r.ts.hour for r in signals.cooled_down(spark.createDataFrame(rows, "ticker string, ts timestamp")).orderBy("ts").collect()]
    assert got == [0, 8, 16]


def test_gate_with_what_was_sent(spark):
    now = dt.datetime(2024, 1, 2)
    scans = spark.createDataFrame([(t, 1, 0.9, 95.0, p) for t, p in (("A", None), ("B", 10.0), ("C", 900.0), ("M", 20.0), ("N", 20.0))], "ticker string, cycle int, confidence double, score double, price double")
    sent = spark.createDataFrame([("B", now - dt.timedelta(hours=7)), ("C", now - dt.timedelta(hours=8)), ("M", now - dt.timedelta(hours=1))], "ticker string, ts timestamp")
    got = signals.alert_gate(scans, ("M", "N"), sent=sent, now=F.lit(now)).collect()
    assert sorted(r.ticker for r in got) == ["A", "C", "N"]


def test_universe(spark):
    queue = spark.createDataFrame([(f"s{i}", i) for i in range(12)], "symbol string, priority int")
    symbols = lambda **k: [r.symbol for r in signals.scan_universe(queue.where("priority < 2"), 9, **k).collect()]
    due = lambda b, m: spark.createDataFrame([(b, m)], "beta boolean, benchmark boolean")
    assert symbols() == ["s0", "s1"] and symbols(cycle=0, tiers=due(False, True)) == ["s0", "s1", "SPY"]
    assert symbols(cycle=0, conservation=True) == ["s0", "s1"]
    turn = [r.symbol for r in signals.scan_universe(queue.where("false"), 9, cycle=0).collect()]
    assert turn == ["SPY", "QQQ", "IWM"]
    later = spark.range(1).select(signals.tier_due(F.lit(dt.datetime(2024, 1, 1)), F.lit(dt.datetime(2024, 1, 1, 0, 15)), 15), signals.tier_due(F.lit(None).cast("timestamp"), F.lit(dt.datetime(2024, 1, 1)), 60)).first()
    assert tuple(later) == (True, True)


def test_fitted_normaliser(spark):
    x, y = np.random.default_rng(0).normal(size=(2, 20, 4))
    fitted = normalize.fit(vectors(spark, x))
    for method, rule in (("zscore", lambda v: (v - x.mean(0)) / x.std(0)), ("rank", lambda v: 1 / (1 + np.exp(-(v - x.mean(0)) / x.std(0)))), ("minmax", lambda v: (v - x.min(0)) / (x.max(0) - x.min(0)))):
        got = [r.vector for r in normalize.transform(vectors(spark, y), fitted, method).orderBy("pattern_id").collect()]
        assert np.array(got) == pytest.approx(rule(y), abs=1e-6)


def test_encoder(spark):
    windows = W.rolling_windows(B.synthetic_bars(spark, ["AAA"], 260, "volatile"))
    raw = encoder.Encoder().encode(windows).collect()
    assert all(len(r.vector) == 49 and r.vector[47] == r.vector[48] == 0 for r in raw)
    timed = encoder.Encoder(warp_drops_time=False).encode(windows).first()
    assert timed.vector[47] ** 2 + timed.vector[48] ** 2 == pytest.approx(1)
    fitted = encoder.Encoder().fit(windows)
    made = np.array([r.vector for r in fitted.encode(windows).collect()])
    assert made.shape[1] == 49 and 0 < made.min() and made.max() < 1
    assert len(fitted.with_directions(windows, 3).encode(windows).first().vector) == 3


def test_failure_analysis_of_nothing(spark):
    m = spark.createDataFrame([(1, 1, "A", 0.9, 1, 0.1, -0.01, 0.1, 3, "mixed_regime")], "query_id long, pattern_id long, ticker string, composite double, rank int, forward_return double, max_drawdown double, max_runup double, time_to_resolution int, outcome_label string")
    got = {r.query_id: r for r in outcomes.failure_analysis(m, spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert got[2].failure_rate == 0 and got[2].n_failure_cases == 0 and list(got[2].signals) == [outcomes.NO_DATA] and not got[2].risks
    assert not got[1].signals


def test_mean_reversion_stays_near(spark):
    spread = {r: B.synthetic_bars(spark, ["AAA", "BBB"], 3000, r, 5).groupBy("ticker").agg((F.stddev("close") / F.first("close")).alias("s")).agg(F.avg("s")).first()[0] for r in ("mean_reverting", "trending")}
    assert spread["mean_reverting"] < spread["trending"]


def test_settings():
    assert config.EngineConfig(days_back=1000).bars_back == 24_000 and config.batch(["A"]) == ["A"]
    for bad in (lambda: config.EngineConfig(days_back=0), lambda: config.batch([]), lambda: config.batch(["A"], 51)):
        with pytest.raises(ValueError):
            bad()


def test_symbols_and_timeframes(spark):
    assert spark.range(1).select(B.symbol(F.lit("btc-usd"))).first()[0] == "X:BTCUSD"
    assert B.bar_length("4 H") == "4 hours"
    with pytest.raises(ValueError):
        B.bar_length("7m")
    with pytest.raises(ValueError):
        B.validated(spark.range(1))


def test_store_and_scan(spark, tmp_path):
    bars = B.synthetic_bars(spark, ["AAA", "BBB"], 300, "volatile")
    patterns = plans.patterns_of(bars)
    n = patterns.count()
    assert plans.ingest(bars, f"{tmp_path}/p") == n and store.store(patterns.drop("pattern_id"), f"{tmp_path}/p") == n
    assert store.load(spark, f"{tmp_path}/p", limit=3).count() == 3
    held = store.load(spark, f"{tmp_path}/p", timeframe="1h")
    assert held.count() == patterns.count()
    other = B.synthetic_bars(spark, ["CCC"], 60, "trending")  # too few for a pattern, enough for a query
    found = plans.scan(bars.unionByName(other), held).collect()
    assert sorted(r.query_id for r in found) == ["AAA", "BBB", "CCC"]
    assert all(r.distribution is not None and r.grade and r.narrative for r in found if r.n_matches)
    assert all(0 <= r.confidence <= 1 and 0 <= r.failure_risk_score <= 1 for r in found)


def test_profiles_and_labels(spark):
    row = spark.range(1).select(labels.outcome_label("0.06", "-0.01", "0.07").alias("a"), labels.echo_type("CAST(NULL AS DOUBLE)", "0", "0").alias("b")).first()
    assert row == ("explosive_continuation", "insufficient_data")


def test_warped_search_equals_full_warping(spark):
    rng = np.random.default_rng(3)
    made = [np.cumsum(rng.normal(size=n)).tolist() for n in [40] * 150 + [25] * 40 + [1, 2, 3]]
    made += [made[0], made[0], [], [5.0] * 40, None]
    rows = [(i, "T", v) for i, v in enumerate(made)]
    patterns = spark.createDataFrame(rows, "pattern_id long, ticker string, vector array<double>")
    queries = patterns.where("pattern_id % 20 = 0 OR pattern_id > 189").selectExpr("pattern_id AS query_id", "vector AS q_vector")
    for top_n in (1, 7, 500):
        got = {}
        for r in warping.find_warped(patterns, queries, top_n, but_itself=True).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.pattern_id, r.warp))
        asked = [i for i, v in enumerate(made) if v is not None and (i % 20 == 0 or i > 189)]
        assert sorted(got) == asked
        for q in asked:
            others = [i for i, v in enumerate(made) if v is not None and i != q]
            warp = {i: float(series.warped_likeness(np.array([made[q]]).reshape(1, -1), np.array([made[i]]).reshape(1, -1))[0]) for i in others}
            best = sorted(warp.values(), reverse=True)[:top_n]
            assert len(got[q]) == len(best)
            np.testing.assert_allclose([w for _, w in got[q]], best, atol=1e-9)
            assert all(abs(warp[i] - w) < 1e-9 for i, w in got[q])


def test_most_pairs_are_not_warped(spark):
    start = np.arange(400) * 0.7
    made = [np.sin(s + np.linspace(0, 5 + i % 9, 60)).tolist() for i, s in enumerate(start)]
    patterns = spark.createDataFrame([(i, "T", v) for i, v in enumerate(made)], "pattern_id long, ticker string, vector array<double>")
    queries = patterns.where("pattern_id % 20 = 0").selectExpr("pattern_id AS query_id", "vector AS q_vector")
    assert warping.candidates(patterns, queries, 5, True).count() < 0.5 * 20 * 399
    assert "BatchEvalPython" not in warping.find_warped(patterns, queries, 5)._jdf.queryExecution().executedPlan().toString()


def test_warping_stops_where_paths_are_too_dear():
    rng = np.random.default_rng(5)
    s, t = series.standard(np.cumsum(rng.normal(size=(300, 50)), 1)), series.standard(np.cumsum(rng.normal(size=(300, 35)), 1))
    whole = series.warping_cost(s, t)
    limit = np.where(np.arange(300) % 3, whole * rng.uniform(0.5, 1.5, 300), whole)
    part = series.warping_cost(s, t, limit)
    assert (part[whole <= limit] == whole[whole <= limit]).all() and (part[whole > limit] > limit[whole > limit]).all()


@pytest.mark.parametrize("places", [range(60), range(7), [0, 2, 3, 4, 5, 6, 7], [0, 1, 1, 2, 3, 4, 5, 6, 6], [0]])
def test_halves_meet_by_place(spark, places):
    """Bars stand where `i` says, whether windows are odd, have gaps, or bars that come twice or have no close."""
    places = list(places)
    close = [None if j == 2 else c for j, c in enumerate(walk(len(places), 5).tolist())]
    rows = [("T", "1h", 0, i, dt.datetime(2024, 1, 1, i % 24), 1.0, 9.0, 1.0, c, 2.0) for i, c in zip(places, close)]
    found = spark.createDataFrame(rows, "ticker string, timeframe string, k int, i int, ts timestamp, open double, high double, low double, close double, volume double")
    mid, early = len(rows) // 2, {}
    for i, c in zip(places, close):
        if i < mid and c is not None:
            early[i] = max(early.get(i, c), c)
    late = [(i, early.get(i - mid), c) for i, c in zip(places, close) if mid <= i < 2 * mid]
    got = features.prepared(found).where("late").select("i", "pair", "close").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, late))
    pairs = np.array([(p, c) for _, p, c in late if p is not None and c is not None])
    want = np.corrcoef(pairs.T)[0, 1] if len(rows) >= 6 and len(pairs) > 1 else 0.0
    assert features.features(found, ("symmetry",)).first().half_corr == pytest.approx(want)


def test_bars_are_sorted_before_columns_are_added(spark):
    """Sorts of windows hold bars alone; what is worked out of them is never sorted again."""
    found = features.fingerprint(W.rolling_windows(frame(spark, walk(200))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2
    assert not any(c in plan[plan.index("Sort [") :] for c in ("jerk5", "sd20", "bw#", "top#"))
