"""Test battles by how new they are to training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.sources.battles import matchup_key

LEVELS = {
    "all_unseen_matchups": ("overall", "is_unseen"),
    "known_decks_new_matchup": ("easy", "is_unseen and team_seen and opponent_seen"),
    "one_new_deck": ("medium", "is_unseen and team_seen != opponent_seen"),
    "two_new_decks": ("hard", "is_unseen and not team_seen and not opponent_seen"),
}


def mark_unseen(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with its unordered matchup and what training saw of it: the matchup, and either deck."""
    key = matchup_key(F.col("team_deck_key"), F.col("opponent_deck_key"))
    matchups = train.select(key.alias("m_key")).distinct().withColumn("m_hit", F.lit(True))
    decks = train.select(F.explode(F.array("team_deck_key", "opponent_deck_key")).alias("deck")).distinct()
    out = test.withColumn("matchup_key", key).join(matchups, F.col("matchup_key") == F.col("m_key"), "left").withColumn("is_unseen", F.col("m_hit").isNull())
    for side in ("team", "opponent"):
        known = decks.select(F.col("deck").alias(f"d_{side}")).withColumn(f"h_{side}", F.lit(True))
        out = out.join(known, F.col(f"{side}_deck_key") == F.col(f"d_{side}"), "left").withColumn(f"{side}_seen", F.col(f"h_{side}").isNotNull())
    return out.drop("m_key", "m_hit", "d_team", "h_team", "d_opponent", "h_opponent")


def levels(marked: DataFrame) -> DataFrame:
    """One row a level: rows, different matchups, and the level's share of the test rows."""
    tests = [F.struct(F.lit(n).alias("level"), F.lit(d).alias("difficulty"), F.expr(c).alias("hit")) for n, (d, c) in LEVELS.items()]
    each = marked.select("matchup_key", F.explode(F.array(*tests)).alias("t"))
    out = each.groupBy("t.level", "t.difficulty").agg(F.count_if("t.hit").alias("rows"), F.count_distinct(F.when(F.col("t.hit"), F.col("matchup_key"))).alias("matchups"), F.count(F.lit(1)).alias("all"))
    return out.select("level", "difficulty", "rows", "matchups", (F.col("rows") / F.nullif(F.col("all").cast("double"), F.lit(0.0))).alias("row_share"))


def level_rows(marked: DataFrame, level: str) -> DataFrame:
    return marked.where(LEVELS[level][1])


def strict_split(marked: DataFrame) -> DataFrame:
    """One row: how many test rows there are, have a matchup of training's, and don't."""
    return marked.agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(~F.col("is_unseen")).alias("excluded_seen_rows"), F.count_if("is_unseen").alias("strict_rows"))
