"""Labels of probabilities. The boundaries differ between them on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def five(p: Column) -> Column:
    return F.when(p < 0.40, "very_bad").when(p < 0.45, "bad").when(p <= 0.55, "neutral").when(p <= 0.60, "good").otherwise("very_good")


def served(p: Column) -> Column:
    """Both bounds belong to the outer labels."""
    return F.when(p >= 0.55, "good").when(p <= 0.45, "bad").otherwise("neutral")


def meta(p: Column, low: float = 0.45, high: float = 0.55) -> Column:
    """Both bounds are neutral."""
    return F.when(p < low, "bad").when(p > high, "good").otherwise("neutral")


def confidence(p: Column) -> Column:
    off = F.abs(p - 0.5)
    return F.when(off < 0.04, "low").when(off >= 0.12, "high").otherwise("medium")


UNFAVORABLE, HARD_COUNTER, FAVORABLE = 0.45, 0.35, 0.55


def support_sigma(n: Column) -> Column:
    return F.when(n >= 300, 0.05).otherwise(0.12)
