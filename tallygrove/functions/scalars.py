"""Scalar functions of tickets: times, numbers, cycles, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO times with or without zone; Z is read, times without a zone are UTC (the session's zone), bad text is null."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.regexp_replace(t, " UTC$", "Z")))


def number(text: Column, default: float = 0.0, least: float | None = None, most: float | None = None) -> Column:
    """A finite number within bounds, default where there is none."""
    v = F.expr("cast(null as double)") if text is None else text.try_cast("double")
    v = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), default).otherwise(v)
    v = v if least is None else F.greatest(v, F.lit(float(least)))
    return v if most is None else F.least(v, F.lit(float(most)))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a cycle."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clamp(value: Column, least: float = 0.0, most: float = 1.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def weighted_blend(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null, weights renormalised; 0 without any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts.values():
        total = total + F.when(value.isNotNull(), value * w).otherwise(0.0)
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def localisation_gate(score: Column, margin: Column, evidence: Column, high: float = 0.6, low: float = 0.35) -> Column:
    """Ordered ladder over best score, margin and the number of kinds of evidence."""
    return (
        F.when(score.isNull(), "no_candidate").when((score >= high) & (margin >= 0.05) & (evidence >= 2), "confident")
        .when((score >= low) & (evidence >= 1), "review").otherwise("insufficient")
    )
