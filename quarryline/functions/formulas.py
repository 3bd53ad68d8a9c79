"""Scoring formulas as Column functions; all stay inside code generation.

Thresholds and weights are fixed values of the scoring model.  Rounding is half away from zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else x


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def churn_multiplier(commits: Column, fixes: Column, authors: Column) -> Column:
    """1 without commits, else grown by the logs of commits, fixes and authors, up to 2."""
    grown = F.lit(1.0) + 0.10 * F.log1p(commits) + 0.20 * F.log1p(fixes) + 0.05 * F.log1p(authors)
    return F.when(commits > 0, clamp(grown, 1, 2)).otherwise(F.lit(1.0))


def impact(complexity: Column, coupling: Column, in_cycle: Column, churn: Column) -> Column:
    return complexity * F.log(F.lit(math.e) + coupling) * F.when(in_cycle, 2.0).otherwise(1.0) * churn


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -20, 20)))


def defect_probability(impact_: Column, kill_rate: Column, b0: float = -1.0, b1: float = 0.1, b2: float = 0.5) -> Column:
    return sigmoid(b0 + b1 * impact_ + b2 * (1 - kill_rate))


def diff_confidence(kill_rate: Column, delta: Column) -> Column:
    return kill_rate / (1 + 0.1 * F.abs(delta))


def risk_profile(complexity: Column, coupling: Column, coverage: Column) -> Column:
    """Weighted sum of three scores of 0 to 100; a missing coverage counts as a score of 80."""
    gap = F.when(coverage.isNull(), 80.0).otherwise(clamp(100 - coverage, 0, 100))  # least and greatest skip nulls
    return 0.45 * F.least(4 * complexity, F.lit(100.0)) + 0.30 * F.least(10 * coupling, F.lit(100.0)) + 0.25 * gap


def priority(score: Column, criticality: Column) -> Column:
    weighted = score * F.when(criticality == "high", 1.2).when(criticality == "low", 0.8).otherwise(1.0)
    return F.when(weighted >= 75, "CRITICAL").when(weighted >= 50, "HIGH").when(weighted >= 25, "MEDIUM").otherwise("LOW")


def instability(afferent: Column, efferent: Column) -> Column:
    total = afferent + efferent
    return F.when(total > 0, F.round(efferent / total, 3)).otherwise(F.lit(0.0))


def main_sequence_distance(abstractness: Column, instability_: Column) -> Column:
    return F.round(F.abs(abstractness + instability_ - 1), 3)


def zone(abstractness: Column, instability_: Column) -> Column:
    near = main_sequence_distance(abstractness, instability_) <= 0.35
    return F.when(near, "MAIN_SEQUENCE").when(abstractness + instability_ < 1, "PAIN").otherwise("USELESSNESS")


def effort(complexity: Column, coupling: Column, loc: Column) -> Column:
    """Lines to rework: at least 5 by the formula, at most all, at least 1."""
    lines = F.round(F.greatest(F.lit(5.0), 3 * complexity + 2.5 * coupling))
    return F.when((complexity == 0) & (coupling == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(lines, loc.cast("double"))))


def roi(complexity: Column, coupling: Column, impact_: Column, loc: Column) -> Column:
    return F.round((0.6 * coupling + 0.4 * complexity) * impact_ / effort(complexity, coupling, loc) * 10, 2)


def reduction_percent(complexity: Column) -> Column:
    return F.round(F.when(complexity > 4, F.least(F.lit(75.0), (complexity - 4) / complexity * 100)).otherwise(0.0), 1)


def cost_reduction(complexity: Column, coupling: Column) -> Column:
    return F.round(clamp(100 * (1 - 10 / F.greatest(F.lit(1.0), complexity * coupling)), 0, 75), 1)


def outcome(before: Column, after: Column, predicted: Column) -> Column:
    actual = F.when(before > 0, clamp((before - after) / before * 100, -100, 100)).otherwise(0.0)
    return F.struct(F.round(actual, 2).alias("actual"), F.round(actual - predicted, 2).alias("variance"), (F.abs(actual - predicted) <= 15).alias("accurate"))


def dynamic_risk(complexity: Column, coupling: Column) -> Column:
    return F.least(F.lit(100.0), 10 * complexity * (1 + 0.1 * coupling))


def watch_impact(complexity: Column, coupling: Column) -> Column:
    return 0.5 * complexity + 1.5 * coupling


def recommendation_confidence(complexity: Column, coupling: Column, fixes: Column) -> Column:
    return clamp(50 + 0.25 * complexity + 0.25 * coupling + 10 * F.least(F.lit(2), fixes), 50, 95)


def health_band(score: Column) -> Column:
    return F.when(score >= 85, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 30, "FAIR").otherwise("POOR")


def consequence(callers: Column, public_weight: Column, centrality: Column, objective: Column, evidence: Column) -> Column:
    goal = F.when(objective == "primary", 3.5).when(objective == "related", 1.8).when(objective == "distant", 0.5).otherwise(1.0)
    return F.round((1 + callers) * F.log(F.lit(math.e) + public_weight) * centrality * goal * evidence, 3)


def product_score(*factors: Column) -> Column:
    """A product that is unknown as soon as one factor is."""
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def blast_score(down: Column, up: Column, complexity: Column) -> Column:
    return F.round((1.5 * down + 1.0 * up) * F.sqrt(complexity), 2)


def relative_luminance(colour: Column) -> Column:
    """Relative luminance of an ``rrggbb`` colour."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast_ratio(a: Column, b: Column) -> Column:
    x, y = relative_luminance(a), relative_luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
