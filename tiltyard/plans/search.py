"""Searches over decks: beam search with admission, and the envelope of plausible scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours_of(decks: DataFrame, pool: DataFrame, cards: str = "cards") -> DataFrame:
    """Every deck with one card changed for one of the pool's (card), each set of cards once. Spark
    broadcasts the pool where it is short."""
    slots = decks.select(cards, F.posexplode(cards).alias("slot", "old"))
    swapped = slots.join(pool.select(F.col("card").alias("new")), ~F.array_contains(F.col(cards), F.col("new")))
    changed = F.array_sort(F.concat(F.array_except(F.col(cards), F.array("old")), F.array("new")))
    return swapped.select(changed.alias(cards)).distinct()


def beam(start: DataFrame, pool: DataFrame, score: Callable[[DataFrame], DataFrame], rounds: int, width: int, admits: Column | None = None, cards: str = "cards") -> DataFrame:
    """Rounds of changing one card: the best ``width`` decks of the old and the new go on; ties by cards.

    The driver loops over rounds, each a plan of its own; between them only the beam is held.
    """
    spark = start.sparkSession
    best = score(start).orderBy(F.desc("score"), cards).limit(width)
    kept = spark.createDataFrame(best.collect(), best.schema)
    for _ in range(rounds):
        found = neighbours_of(kept, pool, cards)
        if admits is not None:
            found = found.where(admits)
        both = kept.unionByName(score(found.join(kept.select(cards), cards, "left_anti")))
        rows = both.orderBy(F.desc("score"), cards).limit(width).collect()
        same = {tuple(r[cards]) for r in rows} == {tuple(r[cards]) for r in kept.collect()}
        kept = spark.createDataFrame(rows, best.schema)
        if same:
            break
    return kept


def leaders(candidates: DataFrame, screen: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame], by: str, top: int) -> DataFrame:
    """A cheap score for all, and the full one only for each group's best by it."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.col("deck_key")))
    best = screen(candidates).withColumn("_place", place).where(F.col("_place") <= top).drop("_place", "score")
    return full(best)
