"""Scores and bands as column expressions; thresholds are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import clamp, ratio


def band(x: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step that x reaches; steps go down."""
    out = None
    for least, name in steps:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def customer_risk(velocity: Column, diversity: Column, monetary: Column, clicks: Column | None = None, monetary_scale: float = 10000.0) -> Column:
    x = 0.08 * velocity + 0.05 * diversity + monetary / monetary_scale
    return F.round(F.least(F.lit(1.0), x if clicks is None else x + 0.01 * clicks), 3)


def lapse_risk(claims: Column, renewal_days: Column, premium: Column) -> Column:
    """Missing claims count 0, missing renewal 999 days."""
    days = F.coalesce(renewal_days, F.lit(999))
    x = 0.18 * F.coalesce(claims, F.lit(0)) + F.greatest(F.lit(0.0), 60.0 - days) / 120 + F.coalesce(premium, F.lit(0.0)) / 20000
    return F.round(F.least(F.lit(1.0), x), 3)


def propensity(monetary: Column, velocity: Column, diversity: Column, recency: Column, monetary_scale: float = 2500.0) -> Column:
    x = F.lit(-1.2) + monetary / monetary_scale + 0.18 * velocity + 0.12 * diversity - 0.04 * recency
    return F.round(1 / (1 + F.exp(-x)), 3)


def risk_band(score: Column) -> Column:
    return band(score, ((0.72, "high"), (0.45, "medium")), "low")


def drift_band(share: Column) -> Column:
    return band(share, ((0.5, "high"), (0.25, "medium")), "low")


def intent(carts: Column, orders: Column, order_amount: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.18 * carts + 0.25 * orders + order_amount / 5000), 3)


def rule_segment(monetary: Column, velocity: Column, recency: Column, high: float = 3000.0, middle: float = 1500.0, min_velocity: int = 3) -> Column:
    return (
        F.when((monetary >= high) & (velocity >= min_velocity), "high_value_active")
        .when(recency <= 7, "recently_active")
        .when(monetary >= middle, "high_value_slow")
        .otherwise("nurture")
    )


def effectiveness(runtime: Column, planned: Column, produced: Column, good: Column, cycle_seconds: Column) -> dict[str, Column]:
    """Availability, performance and quality, each within 0 and 1.25, and their product with the last two capped at 1."""
    availability = clamp(ratio(runtime, planned), 0.0, 1.25)
    performance = clamp(ratio(produced * cycle_seconds, runtime * 60), 0.0, 1.25)
    quality = clamp(ratio(good, produced), 0.0, 1.25)
    oee = availability * F.least(performance, F.lit(1.0)) * F.least(quality, F.lit(1.0))
    return {"availability": availability, "performance": performance, "quality": quality, "oee": oee}
