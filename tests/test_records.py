"""Rounding as Python rounds, and whole records against Python."""

import json
import random

import numpy as np
from test_archive import walks

from recurra.functions import records
from recurra.plans import scan as plans


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, -2.5, 12.25, 0.0, 1e300, -1e17, 4.35, 0.285, 5e-324, 123456789.0005]
    values += [rng.uniform(-1, 1) for _ in range(500)] + [rng.randrange(-10**6, 10**6) / 2000 for _ in range(1500)] + [rng.randrange(10**7) / 20000 + rng.choice([0, 1e-16, -1e-12]) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    found = df.select("x", *(records.exact_round(df.x, p).alias(f"p{p}") for p in (0, 1, 2, 3, 4))).collect()
    for r in found:
        for p in (0, 1, 2, 3, 4):
            if r.x is None or np.isnan(r.x) or np.isinf(r.x):
                assert str(r[f"p{p}"]) == str(r.x)
            else:
                assert r[f"p{p}"] == round(r.x, p), (r.x, p)


def rounded(value, fields):
    """The record that Python makes of a row."""
    out = {}
    for name, source, *places in fields:
        if name == "return_range":
            out[name] = [round(value["return_low"], 4), round(value["return_high"], 4)]
        elif name in ("start_time", "end_time"):
            out[name] = value[source if isinstance(source, str) else name].isoformat()
        elif name == "narrative" and callable(source):
            out[name] = value["projection"]["narrative"]
        elif places and isinstance(places[0], tuple):
            nested, inner = value[source], places[0]
            out[name] = [rounded(x, inner[1:]) for x in nested] if inner[0] == records.MANY else None if nested is None else rounded(nested, inner)
        else:
            x = value[source]
            out[name] = round(x, places[0]) if places and x is not None else x
    return out


def test_scan_records(spark):
    bars = walks(spark, {"A": 260, "B": 240, "C": 70}, 21)
    patterns = plans.patterns_of(bars)
    found = plans.scan_records(bars, patterns, method="hierarchical").collect()
    assert {r.ticker for r in found} == {"A", "B", "C"}
    for r in found:
        made = json.loads(r.record)
        assert made == rounded(r.found.asDict(recursive=True), records.SCAN)
        assert made["n_matches"] == len(made["top_matches"]) > 0 and len(made["failure_analysis"]["failure_cases"]) <= 5
        assert sum(c["n_members"] for c in made["outcome_clusters"]) == made["n_matches"]
        assert [*made] == [f[0] for f in records.SCAN]
    empty = json.loads(plans.scan_records(bars, patterns.limit(0)).first().record)
    assert empty["n_matches"] == 0 and empty["top_matches"] == [] and empty["outcome_distribution"] is None and empty["projection"]["primary_scenario"]["label"] == "insufficient_data"


def test_pattern_and_statistics_records(spark):
    bars = walks(spark, {"A": 260, "B": 240}, 22)
    patterns = plans.patterns_of(bars)
    for r in patterns.select("*", records.as_json(records.PATTERN).alias("json")).collect():
        made = json.loads(r.json)
        assert made["vector_dim"] == 49 and made["start_time"] == r.start_time.isoformat() and made["forward_return"] == r.forward_return
    from recurra.operators import outcomes

    stats = outcomes.statistics(plans.matches_of(bars, patterns))
    for r in stats.select("*", records.as_json(records.STATISTICS).alias("json")).collect():
        assert json.loads(r.json) == rounded(r.asDict(), records.STATISTICS)
