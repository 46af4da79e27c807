"""Rule tables: the first rule that holds names the class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome classes and the thresholds between them, as SQL conditions.
OUTCOME_RULES = (
    ("ret > 0.05 AND dd > -0.03", "explosive_continuation"),
    ("ret > 0.02 AND abs(dd) < 0.03", "slow_grind_continuation"),
    ("ret < -0.03", "full_reversal"),
    ("ru > 0.03 AND ret < 0", "fake_breakout_failure"),
    ("abs(ret) < 0.02 AND abs(dd) > 0.03", "volatility_expansion_directionless"),
    ("ret > 0 AND dd < -0.04", "whipsaw_continuation"),
)
CLUSTER_RULES = (
    ("ret > 0.05 AND dd > -0.03", "explosive_continuation"),
    ("ret > 0.02 AND dd > -0.02", "slow_grind_continuation"),
    ("ret < -0.03", "full_reversal"),
    ("abs(ret) < 0.02 AND ru > 0.03 AND dd < -0.03", "volatility_expansion_directionless"),
    ("ru > 0.03 AND ret < 0", "fake_breakout_failure"),
    ("ret > 0 AND dd < -0.04", "whipsaw_continuation"),
)
ECHO_RULES = (
    ("ret > 0.05 AND dd > -0.03", "explosive_continuation"),
    ("ret > 0.02 AND sd < 0.05", "slow_grind_continuation"),
    ("ret < -0.02 AND dd < -0.05", "full_reversal"),
    ("abs(ret) < 0.02 AND sd > 0.05", "volatility_expansion_directionless"),
    ("ret > 0 AND dd < -0.04", "whipsaw_continuation"),
    ("ret < 0 AND dd < -0.02", "late_stage_compression"),
)
FAILURE_RULES = (
    ("ru > 0.03 AND ret < 0", "false_breakout", "abs(ret - ru) / 0.1"),
    ("dd < -0.08", "severe_drawdown", "abs(dd) / 0.15"),
    ("ret < -0.03 AND abs(dd) < 0.05", "slow_bleed", "abs(ret) / 0.08"),
    ("abs(ru) > 0.03 AND abs(dd) > 0.03 AND abs(ret) < 0.02", "whipsaw", "(abs(ru) + abs(dd)) / 0.15"),
)
CONTINUATIONS = ("explosive_continuation", "slow_grind_continuation", "whipsaw_continuation")
MIXED = "mixed_regime"


def filled(condition: str, **names: str) -> str:
    """A rule with its variables replaced by column expressions."""
    import re

    return reduce(lambda text, pair: re.sub(rf"\b{pair[0]}\b", f"({pair[1]})", text), names.items(), condition)


def case_sql(rules: tuple, default: str, **names: str) -> str:
    whens = " ".join(f"WHEN {filled(r[0], **names)} THEN '{r[1]}'" for r in rules)
    return f"CASE {whens} ELSE {default} END"


def outcome_label(ret: str = "forward_return", dd: str = "max_drawdown", ru: str = "max_runup") -> Column:
    return F.expr(case_sql(OUTCOME_RULES, f"'{MIXED}'", ret=ret, dd=dd, ru=ru))


def cluster_label(ret: str, dd: str, ru: str) -> Column:
    return F.expr(case_sql(CLUSTER_RULES, f"'{MIXED}'", ret=ret, dd=dd, ru=ru))


def echo_type(ret: str, dd: str, sd: str) -> Column:
    """insufficient_data if there is nothing to judge."""
    label = F.expr(case_sql(ECHO_RULES, f"'{MIXED}'", ret=ret, dd=dd, sd=sd))
    return F.when(F.expr(ret).isNull(), "insufficient_data").otherwise(label)


def profiles(vol_z: Column, acceleration: Column, slope: Column, concentration: Column) -> list[Column]:
    """Volatility, momentum and volume profile."""
    return [
        F.when(vol_z < -0.5, "contracting").when(vol_z > 0.5, "expanding").otherwise("stable").alias("volatility_profile"),
        F.when(acceleration > 0.01, "accelerating").when(acceleration < -0.01, "decelerating").otherwise("neutral").alias("momentum_profile"),
        F.when((concentration > 0.35) & (slope > 0.1), "climactic").when(slope < -0.05, "dry").when(slope > 0.05, "accumulating").otherwise("neutral").alias("volume_profile"),
    ]
