"""Pairs a tile at a time: against loops over the numbers, and against SQL."""

import duckdb
import numpy as np
import pytest
from test_queries import DATA, TABLES, pytestmark, rows  # noqa: F401

from recurra import queries as Q
from recurra.functions import series, tiles
from recurra.operators import similarity


@pytest.fixture
def small(monkeypatch):
    """Tiles even for the few queries of the smallest tables."""
    monkeypatch.setattr(similarity, "FEW", 0)
    monkeypatch.setattr(similarity, "SEARCHED", (97, 11))
    monkeypatch.setattr(similarity, "LISTED", (61, 7))


def table(spark, made):
    return spark.createDataFrame([(i, "T", v) for i, v in enumerate(made)], "pattern_id long, ticker string, vector array<double>")


def asked(patterns, rule="pattern_id % 3 = 0"):
    return patterns.where(rule).selectExpr("pattern_id AS query_id", "ticker AS q_ticker", "vector AS q_vector")


def odd():
    """Copies, parallel vectors, nulls, zeros, other lengths, and numbers far apart in size."""
    rng = np.random.default_rng(4)
    made = [rng.normal(size=9).tolist() for _ in range(80)]
    made += made[:30] + [[2 * v for v in made[1]], [0.0] * 9, [0.0] * 9, None, [1.0, None, 2.0], [1.0, 2.0], [2.0, 1.0], [], [1e9] * 9, [1e9 + 1] * 9, [1e-12] * 9]
    return made


def alone(a, b, weights):
    """The composite of two vectors, number by number."""
    dot = x2 = y2 = gap = 0.0
    for x, y in zip(a, b):
        dot, x2, y2, gap = dot + x * y, x2 + x * x, y2 + y * y, gap + (x - y) * (x - y)
    cos = 0.0 if min(x2, y2) < 1e-20 else max(-1.0, min(dot / np.sqrt(x2 * y2), 1.0))
    cross = float(series.best_lag(np.array([a]).reshape(1, -1), np.array([b]).reshape(1, -1))[0]) if weights[2] else 0.0
    return weights[0] * cos + weights[1] * float(np.exp(-np.sqrt(gap) / (np.sqrt(len(a)) + 1e-10))) + weights[2] * cross


@pytest.mark.parametrize("weights", [(0.6, 0.4, 0.0), (0.5, 0.3, 0.2)])
def test_search_by_tiles_is_that_of_a_loop(spark, small, weights):
    made, threshold, top_n = odd(), 0.15, 6
    patterns = table(spark, made)
    find = similarity.find_matches if weights[2] else similarity.find_matches_batch
    found = find(patterns, asked(patterns), top_n, threshold, but_itself=True)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.pattern_id, r.composite))
    usable = [i for i, v in enumerate(made) if v is not None and None not in v]
    for q in (i for i in usable if i % 3 == 0):
        scores = [(-alone(made[q], made[i], weights), i) for i in usable if i != q and len(made[i]) == len(made[q])]
        want = sorted((round(s, 9), i) for s, i in scores if -s >= threshold)[:top_n]
        assert [(round(-s, 9), i) for i, s in got.pop(q, [])] == want
    assert not got


def test_listed_pairs(spark, small):
    made = odd()
    patterns = table(spark, made)
    for rule, name, of in ((tiles.correlations, "xcorr", series.best_lag), (tiles.warpings, "dtw", series.warped_likeness), (tiles.likenesses, "cosine", None)):
        names = ("cosine", "euclidean") if name == "cosine" else (name,)
        found = similarity.listed(patterns, asked(patterns), rule, names, True, name != "cosine").collect()
        assert len(found) == len({(r.query_id, r.pattern_id) for r in found}) == len(made[::3]) * (len(made) - 1)
        for r in found[::7]:
            a, b = made[r.query_id], made[r.pattern_id]
            if a is None or b is None or None in a or None in b or (name == "cosine" and len(a) != len(b)):
                assert r[name] is None
            elif name == "cosine":
                assert 0.6 * r.cosine + 0.4 * r.euclidean == pytest.approx(alone(a, b, (0.6, 0.4, 0.0)), abs=1e-12)
            else:
                assert r[name] == pytest.approx(float(of(np.array([a]).reshape(1, -1), np.array([b]).reshape(1, -1))[0]), abs=1e-9)


@pytest.mark.parametrize("name", "topk_batch signals sim_pairs cluster_summary clusters clusters_hierarchical confidence distribution_stats echo_type outcome_stats rerank scenarios projections_hierarchical topk_per_query trade_cards warnings sim_dtw failure_analysis sim_xcorr topk_exact failure_cases failure_summary scenarios_hierarchical".split())
def test_query_by_tiles(spark, small, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    got = rows(df.collect(), df.columns)
    assert got[1]
    if name in Q.ORACLES:
        found = con.execute(Q.ORACLES[name])
        assert got == rows(found.fetchall(), [d[0] for d in found.description])
