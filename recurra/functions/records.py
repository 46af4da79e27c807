"""Results as JSON records: every nested number rounded to its own places.

A record is described by its fields, in order: (name, source) or (name, source,
places), where places may be a description itself, for a nested struct or an
array of them, which is marked by `many`.  Numbers are rounded half to even on their exact binary value, as
Python's `round` does: 0.125 gives 0.12, 0.375 gives 0.38, and 2.675, which is a
little less than that in binary, 2.67.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2 to the 27th and one: cuts a double into halves whose products are exact


MANY = "many"


def many(fields: tuple) -> tuple:
    """The description of an array of such records."""
    return (MANY, *fields)


def exact_round(x: Column, places: int) -> Column:
    """x to so many places; null, NaN and infinite values stay.

    x times 10^places is taken as the nearest double and the exact rest, so ties are told from what only looks like one.
    """
    scale = 10.0**places
    high = scale * _SPLIT - (scale * _SPLIT - scale)
    low = scale - high
    y = x * scale
    xh = x * _SPLIT - (x * _SPLIT - x)
    xl = x - xh
    rest = ((xh * high - y) + xh * low + xl * high) + xl * low
    whole = F.floor(y).cast("double")
    part = y - whole
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    small = F.abs(y) < 2.0**52  # beyond, all doubles are multiples of more than half a unit
    return F.when(small, (whole + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)


def record(fields: tuple, of: Column | None = None) -> Column:
    """The struct that a description makes of the columns of a table, or of the fields of a struct."""
    get = (lambda name: F.col(name)) if of is None else (lambda name: of[name])
    made = []
    for name, source, *places in fields:
        value = source(get) if callable(source) else get(source)
        if places and isinstance(places[0], tuple):
            nested = places[0]
            value = F.transform(value, _each(nested[1:])) if nested[0] is MANY else F.when(value.isNotNull(), record(nested, value))
        elif places:
            value = exact_round(value, places[0])
        made.append(value.alias(name))
    return F.struct(*made)


def _each(fields: tuple):
    return lambda x: record(fields, x)


def iso(source: str):
    return lambda get: F.date_format(get(source), "yyyy-MM-dd'T'HH:mm:ss")


def _same(names: str, places: int | None = None) -> tuple:
    return tuple((n, n) if places is None else (n, n, places) for n in names.split())


# Fields of the records, with the places of their numbers.
PATTERN = (
    *_same("ticker timeframe"), ("start_time", iso("start_time")), ("end_time", iso("end_time")),
    *_same("window_size forward_return max_drawdown max_runup time_to_resolution outcome_label volatility_profile momentum_profile volume_profile"),
    ("vector_dim", lambda get: F.size(get("vector"))),
)
MATCH = (
    *_same("ticker"), ("start_time", iso("start_time")), ("end_time", iso("end_time")), ("similarity", "composite", 4), *_same("cosine euclidean forward_return max_drawdown", 4),
    *_same("time_to_resolution outcome_label rank"),
)
CLUSTER = (*_same("cluster_id label n_members"), ("probability", "probability", 3), *_same("avg_return avg_drawdown avg_runup", 4), ("avg_time_to_resolution", "avg_time_to_resolution", 1))
DISTRIBUTION = (
    *_same("continuation reversal failure neutral", 3), *_same("mean_return median_return", 4), ("std_return", "std_return", 4), *_same("skew kurtosis", 3),
    *_same("percentile_5 percentile_25 percentile_75 percentile_95", 4),
)
STATISTICS = (
    ("n_matches", "n_matches"), ("continuation_probability", "continuation", 3), ("reversal_probability", "reversal", 3), ("failure_probability", "failure", 3),
    ("avg_return", "mean_return", 4), ("median_return", "median_return", 4), ("weighted_avg_return", "weighted_return", 4), ("max_adverse_excursion", "worst_drawdown", 4),
    ("max_favorable_excursion", "best_runup", 4), ("avg_time_to_resolution", "mean_resolution", 1), ("median_time_to_resolution", "median_resolution", 1),
    ("return_std", "return_std", 4), ("sharpe_proxy", "sharpe", 3), *_same("win_rate profit_factor", 3),
)
CASE = (*_same("ticker failure_type"), ("severity", "severity", 3), *_same("divergence_bar"))
FAILURE = (
    ("failure_rate", "failure_rate", 3), ("avg_failure_severity", "avg_severity", 3), ("max_failure_severity", "max_severity", 3), ("failure_risk_score", "failure_risk_score", 3),
    *_same("n_failure_cases"), ("divergence_signals", "signals"), ("risk_factors", "risks"), ("failure_cases", "cases", many(CASE)),
)
SCENARIO = (
    *_same("label"), ("probability", "probability", 3), ("expected_return", "expected_return", 4),
    ("return_range", lambda get: F.array(exact_round(get("return_low"), 4), exact_round(get("return_high"), 4))),
    ("time_to_resolution", "resolution"), ("confidence", "confidence", 3), *_same("description"),
)
PROJECTION = (("primary_scenario", "primary", SCENARIO), ("alternative_scenarios", "alternatives", many(SCENARIO)), ("overall_confidence", "overall_confidence", 3), *_same("time_horizon narrative"))
SCAN = (
    *_same("ticker timeframe window_size"), ("similarity_score", "similarity", 4), ("echo_type", "echo_type"), ("confidence", "confidence", 3), ("n_matches", "n_matches"),
    ("top_matches", "matches", many(MATCH)), ("outcome_distribution", "distribution", DISTRIBUTION), ("outcome_clusters", "clusters", many(CLUSTER)), ("failure_analysis", "failures", FAILURE),
    ("projection", "projection", PROJECTION), ("narrative", lambda get: get("projection")["narrative"]),
)


def as_json(fields: tuple) -> Column:
    """One record a row, nulls kept."""
    return F.to_json(record(fields), {"ignoreNullFields": "false"})
