"""Empirical matchup priors: five levels of keys, learned from training battles alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("archGlobal", "archBucket", "planGlobal", "planBucket", "spellAnswerGlobal")
Describe = Callable[[Column], Column]


def clamped(p: Column) -> Column:
    """Within [0.001, 0.999]; what isn't a number is one half."""
    return F.when(p.isNull() | F.isnan(p), 0.5).otherwise(F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999)))


def keys(battles: DataFrame, archetype: Describe, plan: Describe, spells: Describe, bucket: Column) -> DataFrame:
    """Each battle's key of every level: ``[bucket#]mine>theirs``, for the team's side."""
    a, b = F.col("team_card_ids"), F.col("opponent_card_ids")
    pair = lambda f: F.concat(f(a), F.lit(">"), f(b))
    arch, path, answer = pair(archetype), pair(plan), F.concat(spells(a), F.lit(">"), archetype(b))
    in_bucket = lambda k: F.concat(bucket, F.lit("#"), k)
    return battles.withColumns(dict(zip(LEVELS, (arch, in_bucket(arch), path, in_bucket(path), answer))))


def matrix(keyed: DataFrame, swapped_keyed: DataFrame, strength: float = 20.0) -> DataFrame:
    """(level, key, n, delta, weight): how far a key's win rate lies from a half, drawn to it by ``strength``;
    each battle counts for both sides, so that a key and its reverse mirror each other."""
    both = keyed.select("win", *LEVELS).union(swapped_keyed.select("win", *LEVELS))
    each = both.select("win", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("key")) for n in LEVELS])).alias("k")).select("win", "k.*")
    out = each.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("wins"))
    n = F.col("n")
    return out.select("level", "key", "n", ((F.col("wins") - n / 2) / (n + strength)).alias("delta"), (n / (n + strength)).alias("weight"))


def attach(keyed: DataFrame, matrix_: DataFrame, id_: str = "game_id") -> DataFrame:
    """With ``matrix_prior`` and, for each level, whether the matrix covers it: the weighted mean of the levels'
    deltas about a half. The matrix is of kinds of decks, not of battles; Spark broadcasts it if it is small."""
    out = keyed
    for n in LEVELS:
        part = matrix_.where(F.col("level") == n).select(F.col("key").alias(f"_k_{n}"), F.col("delta").alias(f"_d_{n}"), F.col("weight").alias(f"_w_{n}"))
        out = out.join(part, F.col(n) == F.col(f"_k_{n}"), "left")
    add = lambda cs: reduce(lambda x, y: x + y, cs)
    w = add([F.coalesce(f"_w_{n}", F.lit(0.0)) for n in LEVELS])
    d = add([F.coalesce(F.col(f"_w_{n}") * F.col(f"_d_{n}"), F.lit(0.0)) for n in LEVELS])
    p = clamped(F.lit(0.5) + F.coalesce(d / F.nullif(w, F.lit(0.0)), F.lit(0.0)))
    covered = {f"covered_{n}": F.col(f"_k_{n}").isNotNull() for n in LEVELS}
    return out.withColumns({"matrix_prior": p} | covered).drop(*[f"_{x}_{n}" for n in LEVELS for x in "kdw"], *LEVELS)


def coverage(attached: DataFrame) -> DataFrame:
    return attached.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(f"covered_{n}").cast("int")).alias(n) for n in LEVELS])


def provided(battles: DataFrame, provider: Callable, schema: str = "double") -> DataFrame:
    """A prior from any function of a pandas frame's batch, kept within bounds."""

    def run(batches):
        for batch in batches:
            yield batch.assign(matrix_prior=provider(batch))

    kind = battles.drop("matrix_prior").schema.simpleString()[7:-1]
    out = battles.drop("matrix_prior").mapInPandas(run, f"{kind},matrix_prior:{schema}")
    return out.withColumn("matrix_prior", clamped(F.col("matrix_prior")))
