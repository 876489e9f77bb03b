"""A win-probability model that is exactly antisymmetric, with calibration, records and attribution."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions import labels
from tiltyard.operators.correction import fit_calibrations, hero_adjustment, logit, projected, projection_error, sigmoid, with_lines
from tiltyard.sources.battles import swapped


def indicators(cards: Sequence[int], pairs: Sequence[tuple[int, int]], prior: str | None = None) -> Column:
    """Features that all change sign with the sides: a card's presence in the team less that in the opponent, a
    pair's a against b less b against a, and the prior's logit."""
    team, other = F.col("team_card_ids"), F.col("opponent_card_ids")
    has = lambda side, c: F.array_contains(side, F.lit(c).cast("bigint")).cast("double")
    out = [has(team, c) - has(other, c) for c in cards]
    out += [has(team, a) * has(other, b) - has(other, a) * has(team, b) for a, b in pairs]
    return F.array(*out, *([logit(F.col(prior).cast("double"))] if prior else []))


@dataclass
class Model:
    cards: list[int]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    prior: str | None = None
    lines: DataFrame | None = None
    coefficients: dict[int, float] = field(default_factory=dict)
    shrinkage: float = 0.75

    def score(self, battles: DataFrame) -> DataFrame:
        """With ``logit``: one weighted sum inside the row; no Python and no shuffle."""
        x = indicators(self.cards, self.pairs, self.prior)
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        return battles.withColumn("logit", F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))

    def probabilities(self, battles: DataFrame) -> DataFrame:
        """With the probability from both sides, projected, corrected and labelled.

        The other side's logit is this one's with its sign turned, so both sides come from one pass over the
        rows: nothing is shuffled and the few calibrations are broadcast.
        """
        out = self.score(battles)
        out = with_lines(out, self.lines) if self.lines is not None else out.withColumns({"temperature": F.lit(1.0), "bias": F.lit(0.0), "global_temperature": F.lit(1.0)})
        x, t, b = F.col("logit"), F.greatest("temperature", F.lit(1e-4)), F.col("bias")
        out = out.withColumns({"raw": sigmoid(x), "raw_reverse": sigmoid(-x), "forward": sigmoid(x / t + b), "reverse": sigmoid(-x / t + b)})
        out = out.withColumns({"pre_correction": projected(F.col("forward"), F.col("reverse")), "calibration_symmetry_error": projection_error(F.col("forward"), F.col("reverse"))})
        correct = bool(self.coefficients) and "team_evolution_levels" in battles.columns
        out = out.withColumn("adjustment", hero_adjustment(self.coefficients, self.shrinkage) if correct else F.lit(0.0))
        p = F.when(F.col("adjustment") == 0, F.col("pre_correction")).otherwise(sigmoid(logit(F.col("pre_correction"), 1e-7) + F.col("adjustment")))
        out = out.withColumn("probability", p)
        return out.withColumns({"label": labels.five(F.col("probability")), "served_label": labels.served(F.col("probability")), "confidence": labels.confidence(F.col("probability"))})

    def records(self, battles: DataFrame) -> DataFrame:
        """One prediction record of seventeen fields a battle, beside its id."""
        out = self.probabilities(battles)
        p, error = F.col("probability"), lambda a, b: F.abs(F.col(a) + F.col(b) - 1)
        return out.select(
            "game_id", p.alias("team_win_probability"), (1 - p).alias("opponent_win_probability"), F.col("pre_correction").alias("pre_correction_team_win_probability"),
            F.col("adjustment").alias("hero_evo_logit_adjustment"), F.col("forward").alias("pre_projection_team_win_probability"), F.col("reverse").alias("pre_projection_opponent_win_probability"),
            F.col("raw").alias("raw_team_win_probability"), F.col("raw_reverse").alias("raw_opponent_win_probability"), F.col("label").alias("matchup_label"),
            F.lit(0.0).alias("symmetry_error"), "calibration_symmetry_error", error("raw", "raw_reverse").alias("raw_symmetry_error"), "segment", "patch", "temperature", "bias", "global_temperature",
        )

    def to_json(self) -> str:
        rows = [r.asDict() for r in self.lines.collect()] if self.lines is not None else None  # a line a segment
        return json.dumps({"cards": self.cards, "pairs": self.pairs, "weights": self.weights.tolist(), "prior": self.prior, "lines": rows, "coefficients": {str(k): v for k, v in self.coefficients.items()}, "shrinkage": self.shrinkage})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Model:
        d = json.loads(text)
        lines = spark.createDataFrame([tuple(r[c] for c in ("segment", "temperature", "bias", "rows")) for r in d["lines"]], "segment string, temperature double, bias double, rows bigint") if d["lines"] is not None else None
        return cls(d["cards"], [tuple(p) for p in d["pairs"]], np.array(d["weights"]), d["prior"], lines, {int(k): v for k, v in d["coefficients"].items()}, d["shrinkage"])

    def attributions(self, battles: DataFrame, top: int = 3) -> DataFrame:
        """What each pair adds to a battle's logit, (game_id, kind, a, b, delta): the largest few for the team
        (answers) and against it (threats). With a linear logit this is what leaving the pair out takes away."""
        team, other = F.col("team_card_ids"), F.col("opponent_card_ids")
        start = len(self.cards)
        has = lambda side, c: F.array_contains(side, F.lit(c).cast("bigint")).cast("double")
        parts = [
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(float(w)) * (has(team, a) * has(other, b) - has(other, a) * has(team, b))).alias("delta"))
            for (a, b), w in zip(self.pairs, self.weights[start : start + len(self.pairs)])
        ]
        if not parts:
            return battles.select("game_id", F.lit("answer").alias("kind"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("delta")).where(F.lit(False))
        sized = F.sort_array(F.transform(F.array(*parts), lambda p: F.struct(p["delta"].alias("delta"), p["a"].alias("a"), p["b"].alias("b"))))
        good = F.filter(F.slice(F.reverse(sized), 1, top), lambda p: p["delta"] > 0)
        bad = F.filter(F.slice(sized, 1, top), lambda p: p["delta"] < 0)
        both = F.concat(F.transform(good, lambda p: F.struct(F.lit("answer").alias("kind"), p["a"].alias("a"), p["b"].alias("b"), p["delta"].alias("delta"))), F.transform(bad, lambda p: F.struct(F.lit("threat").alias("kind"), p["a"].alias("a"), p["b"].alias("b"), p["delta"].alias("delta"))))
        return battles.select("game_id", F.explode(both).alias("p")).select("game_id", "p.*")


def train(battles: DataFrame, cards: Sequence[int], pairs: Sequence[tuple[int, int]] = (), prior: str | None = None, weight: str | None = None, smoothing: float = 0.0, penalty: float = 1e-4) -> Model:
    """Logistic regression without intercept over features that change sign with the sides, so that
    P(A beats B) = 1 - P(B beats A) for whatever weights it finds. Label smoothing is two weighted rows."""
    y = F.col("win").cast("double")
    rows = battles.select(array_to_vector(indicators(cards, pairs, prior)).alias("features"), y.alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    if smoothing:
        rows = rows.select("features", F.explode(F.array(F.struct(F.col("label").alias("l"), (F.col("weight") * (1 - smoothing / 2)).alias("w")), F.struct((1 - F.col("label")).alias("l"), (F.col("weight") * smoothing / 2).alias("w")))).alias("x"))
        rows = rows.select("features", F.col("x.l").alias("label"), F.col("x.w").alias("weight"))
    fitted = LogisticRegression(fitIntercept=False, regParam=penalty, weightCol="weight", standardization=False, maxIter=100, tol=1e-10).fit(rows)
    return Model(list(cards), list(pairs), fitted.coefficients.toArray(), prior)


def calibrate(model: Model, validation: DataFrame, least: int = 2000, bias: bool = True) -> Model:
    scored = model.score(validation).withColumn("target", F.col("win"))
    model.lines = fit_calibrations(scored, least=least, bias=bias)
    return model


def augmented(battles: DataFrame, seed: int = 0) -> DataFrame:
    """Each battle from one of its sides, drawn by a hash of its id and the epoch's seed."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("game_id").cast("string")).cast("binary"))
    turn = F.coalesce(F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint") % 2 == 1, F.lit(False))
    return battles.where(~turn).unionByName(swapped(battles.where(turn)))


def block_sample(battles: DataFrame, blocks: int, seed: int) -> DataFrame:
    """A bootstrap of blocks of rows with replacement: a block's number of copies is a hash's Poisson draw."""
    from tiltyard.operators.metrics import poisson_one

    block = F.pmod(F.xxhash64("game_id"), F.lit(blocks))
    return battles.withColumn("_copies", poisson_one(block, F.lit(0), seed)).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
