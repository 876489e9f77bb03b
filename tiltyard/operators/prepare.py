"""From raw battles to leakage-safe splits: deduplication, windows, cut-offs, vocabularies, reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltyard.operators.metrics import percentiles_of, value_counts


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order. Aggregated before the shuffle, unlike a window: only the
    best row of a key leaves a task, whatever the key's share of the rows."""
    place = [f"_o{i}" for i in range(len(order))]
    ordered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[o.alias(n) for o, n in zip(order, place)])
    best = ordered.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("row", F.struct(*place)).alias("row"))
    return best.select("row.*")


def new_rows(batch: DataFrame, seen: DataFrame, key: str, *order: Column) -> DataFrame:
    """A batch's first row of each key that was not seen before."""
    return first_of(batch, [key], *order).join(seen.select(F.col(key).alias("_seen")), F.col(key) == F.col("_seen"), "left_anti")


def history(df: DataFrame, time: str, days: float) -> DataFrame:
    """Rows of the last so many days before the newest; the cut is a constant, so that it reaches the scan."""
    newest = df.agg(F.max(time)).first()[0]
    if newest is None:
        raise ValueError("no rows in the history window")
    return df.where(F.col(time) >= F.lit(newest - timedelta(days=days)).cast(df.schema[time].dataType))


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def cutoffs(df: DataFrame, time: str = "battle_time", shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """One row (c1, c2): exact interpolated quantiles of the time, in seconds."""
    counts = value_counts(df, micros(F.col(time)) / 1e6).persist()
    try:  # two numbers, found now, so that plans that use them don't find them again
        row = percentiles_of(counts, {"c1": shares[0], "c2": shares[1]}).first()
    finally:
        counts.unpersist()
    return df.sparkSession.createDataFrame(pa.table({n: pa.array([row[n]], pa.float64()) for n in ("c1", "c2")}))


def split(df: DataFrame, cuts: DataFrame, time: str = "battle_time") -> DataFrame:
    """With the split of each row: train up to the first cut-off, test after the second."""
    at = micros(F.col(time)) / 1e6
    which = F.when(at <= F.col("c1"), "train").when(at <= F.col("c2"), "validation").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", which).drop("c1", "c2")


def vocabulary(values: DataFrame, value: str, seeds: Sequence | None = None) -> DataFrame:
    """Dense indexes from 1 in the values' order; 0 stays for padding and the unknown. The number of different
    values is that of cards or segments, so one sorted task is small whatever the rows are."""
    kind = values.schema[value].dataType
    known = values.select(value).where(F.col(value).isNotNull())
    if seeds:
        known = known.union(values.sparkSession.createDataFrame([(s,) for s in seeds], f"{value} {kind.simpleString()}"))
    return known.distinct().withColumn("index", F.row_number().over(Window.orderBy(value)))


def cards_of(battles: DataFrame) -> DataFrame:
    return battles.select(F.explode(F.concat("team_card_ids", "opponent_card_ids")).alias("card"))


def card_frequencies(battles: DataFrame) -> DataFrame:
    return cards_of(battles).groupBy("card").agg(F.count(F.lit(1)).alias("n"))


def unseen_cards(battles: DataFrame, train: DataFrame) -> DataFrame:
    """Cards of the corpus that training never shows."""
    return cards_of(battles).distinct().join(cards_of(train).distinct(), "card", "left_anti")


def manifest(split_battles: DataFrame) -> DataFrame:
    """One row: rows of each split, sizes of the vocabularies with the place for the unknown, first and last time."""
    train = F.col("split") == "train"
    counts = [F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")]
    sizes = [(F.count_distinct(F.when(train, F.col(c))) + 1).alias(f"{c}_vocabulary") for c in ("segment", "patch")]
    cards = cards_of(split_battles.where(train)).agg((F.count_distinct("card") + 1).alias("card_vocabulary"))
    return split_battles.agg(*counts, *sizes, F.min("battle_time").alias("first_time"), F.max("battle_time").alias("last_time")).crossJoin(cards)


def inverse_weights(frequencies: DataFrame, power: float = 0.5, cap: float = 10.0) -> DataFrame:
    """Card weights (1/n)**power, scaled so that their mean over uses is one, and then capped."""
    raw = frequencies.withColumn("w", F.pow(1 / F.col("n"), F.lit(power)))
    mean = raw.agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("card", "n", F.least(F.greatest(F.col("w") / F.col("mean"), F.lit(0.0)), F.lit(cap)).alias("weight"))


def sample_weights(battles: DataFrame, weights: DataFrame) -> DataFrame:
    """A battle's weight: the mean of its cards' positive weights."""
    used = battles.select("game_id", F.explode(F.concat("team_card_ids", "opponent_card_ids")).alias("card")).join(F.broadcast(weights.select("card", "weight")), "card", "left")
    positive = F.col("weight") > 0
    return used.groupBy("game_id").agg((F.coalesce(F.sum(F.when(positive, F.col("weight"))), F.lit(0.0)) / F.greatest(F.count_if(positive), F.lit(1))).alias("weight"))


def segment_diagnostics(battles: DataFrame) -> DataFrame:
    """Each ranked segment's games, their share, and whether they lack a league."""
    n = battles.where(F.col("segment").startswith("ranked:")).groupBy("segment").agg(F.count(F.lit(1)).alias("games"))
    return n.withColumn("share", F.col("games") / F.sum("games").over(Window.partitionBy())).withColumn("unknown", F.col("segment") == "ranked:unknown")


def evened(df: DataFrame, files: int = 12) -> DataFrame:
    """The same rows dealt evenly to so many files, checked by count."""
    out = df.repartition(files)
    if out.count() != df.count():
        raise RuntimeError("repartitioning changed the number of rows")
    return out
