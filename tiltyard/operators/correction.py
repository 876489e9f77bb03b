"""Post-calibration adjustments of probabilities: projection, temperature, and the hero with evolution term."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logit(p: Column, by: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(by)), F.lit(1 - by))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def projected(forward: Column, reverse: Column) -> Column:
    """The antisymmetric part of a score seen from both sides: p and 1 - p add up exactly."""
    return F.least(F.greatest(0.5 * (forward + 1 - reverse), F.lit(0.0)), F.lit(1.0))


def projection_error(forward: Column, reverse: Column) -> Column:
    return F.abs(forward + reverse - 1)


def side_term(cards: Column, evolutions: Column, heroes: Column, coefficients: dict[int, float], size: int = 8) -> Column:
    """The sum of a side's heroes' coefficients, if any card of the side is evolved."""
    zipped = F.slice(F.arrays_zip(cards.alias("c"), evolutions.alias("e"), heroes.alias("h")), 1, size)
    flag = lambda x: F.greatest(F.coalesce(x["e"], F.lit(0)).cast("int"), F.lit(0))
    evolved = F.exists(zipped, lambda x: flag(x).bitwiseAND(1) > 0)
    table = F.create_map(*[F.lit(v) for c, w in coefficients.items() for v in (int(c), float(w))]) if coefficients else None
    value = (lambda x: F.coalesce(F.element_at(table, x["c"].cast("int")), F.lit(0.0))) if coefficients else (lambda x: F.lit(0.0))
    heroic = F.filter(zipped, lambda x: (F.coalesce(x["h"], F.lit(0)) > 0) | (flag(x).bitwiseAND(2) > 0))
    return F.when(evolved, F.aggregate(heroic, F.lit(0.0), lambda a, x: a + value(x))).otherwise(0.0)


def hero_adjustment(coefficients: dict[int, float], shrinkage: float = 0.75) -> Column:
    """What is added to the calibrated logit: team less opponent, so it changes sign with the sides."""
    if not 0 <= shrinkage <= 1:
        raise ValueError("shrinkage lies between 0 and 1")
    side = lambda s: side_term(F.col(f"{s}_card_ids"), F.col(f"{s}_evolution_levels"), F.col(f"{s}_hero_levels"), coefficients)
    return F.lit(float(shrinkage)) * (side("team") - side("opponent"))


def fit_calibrations(df: DataFrame, by: str = "segment", score: str = "logit", target: str = "target", least: int = 2000, bias: bool = True) -> DataFrame:
    """(segment, temperature, bias): one line a segment that has ``least`` rows and both results, and one for all
    rows under a null segment. Equal scores are summed first, so a group is its different scores."""
    both = df.select(F.explode(F.array(F.col(by), F.lit(None).cast("string"))).alias(by), F.round(score, 6).alias("x"), F.col(target).cast("double").alias("y"))
    sums = both.groupBy(by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, wins = pdf["n"].sum(), pdf["y"].sum()
        name = pdf[by].iloc[0]
        if (name is not None and n < least) or wins in (0, n):
            return pd.DataFrame({by: [], "temperature": [], "bias": [], "rows": []})
        x = np.repeat(pdf["x"].to_numpy(), 2)
        w = np.column_stack([pdf["y"], pdf["n"] - pdf["y"]]).ravel()
        t, b = weighted_line(x, np.tile([1.0, 0.0], len(pdf)), w, bias)
        return pd.DataFrame({by: [name], "temperature": [t], "bias": [b], "rows": [int(n)]})

    return sums.groupBy(by).applyInPandas(fit, f"{by} string, temperature double, bias double, rows bigint")


def weighted_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: bool = True, steps: int = 100) -> tuple[float, float]:
    """Temperature and bias of least log loss for sigmoid(x / T + b), by Newton; T in [0.05, 10], b in [-5, 5]."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        w, r = weight * (p * (1 - p) + 1e-12), weight * (y - p)
        g = np.array([(r * x).sum(), r.sum()])
        h = np.array([[(w * x * x).sum() + 1e-9, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g) if bias else np.array([g[0] / h[0, 0], 0.0])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    t = 1 / a if a > 1e-9 else 10.0
    return float(np.clip(t, 0.05, 10)), float(np.clip(b, -5, 5))


def with_lines(df: DataFrame, lines: DataFrame, by: str = "segment") -> DataFrame:
    """With ``temperature`` and ``bias``, a segment's own or else those of all rows, and the latter's temperature."""
    own = lines.where(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.col("temperature").alias("_t"), F.col("bias").alias("_b"))
    every = lines.where(F.col(by).isNull()).agg(F.coalesce(F.max("temperature"), F.lit(1.0)).alias("global_temperature"), F.coalesce(F.max("bias"), F.lit(0.0)).alias("_gb"))
    out = df.join(F.broadcast(own), F.col(by) == F.col("_by"), "left").crossJoin(F.broadcast(every))
    return out.withColumns({"temperature": F.coalesce("_t", "global_temperature"), "bias": F.coalesce("_b", "_gb")}).drop("_by", "_t", "_b", "_gb")


def calibrated(df: DataFrame, lines: DataFrame, by: str = "segment", score: str = "logit") -> DataFrame:
    """With ``probability``: the score through its segment's line."""
    return with_lines(df, lines, by).withColumn("probability", sigmoid(F.col(score) / F.col("temperature") + F.col("bias"))).drop("temperature", "bias", "global_temperature")


def interactions(scored: DataFrame, by: list[str], hero: str = "hero", evo: str = "evo", value: str = "probability") -> DataFrame:
    """Two-by-two contrasts (p11 - p01) - (p10 - p00) of a value over two flags."""
    of = lambda h, e: F.avg(F.when((F.col(hero) == h) & (F.col(evo) == e), F.col(value)))
    return scored.groupBy(*by).agg(of(True, True).alias("p11"), of(False, True).alias("p01"), of(True, False).alias("p10"), of(False, False).alias("p00")).withColumn("interaction", (F.col("p11") - F.col("p01")) - (F.col("p10") - F.col("p00")))
