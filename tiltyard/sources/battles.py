"""Battles as DataFrames: derived ones over order tables, oriented sides, and matchup keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions.decks import deck_key


def card_universe(spark: SparkSession, sf_dir: str) -> int:
    """As many cards as the root of the parts' number, ten at least: decks of few cards meet again, yet there are
    more of them the more parts there are. The count is the file's own."""
    return max(10, math.isqrt(spark.read.parquet(f"{sf_dir}/part.parquet").count()))


GROWING = "(select greatest(10, floor(sqrt(count(*)))::bigint) from part)"  # the same in SQL


def derived_battles(spark: SparkSession, sf_dir: str, universe: int | None = 6) -> DataFrame:
    """Battles made from orders: an order's deck is its parts modulo ``universe`` (None: its parts as they are), an
    odd order meets the one after it, and the larger quantity wins; draws are dropped."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    card = F.col("l_partkey") if universe is None else (F.col("l_partkey") % universe).cast("int")
    decks = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_set(card)).alias("cards"),
        F.round(F.sum("l_quantity")).cast("bigint").alias("q"),
    )
    side = orders.join(decks, orders["o_orderkey"] == decks["k"]).select("k", F.col("o_orderdate").alias("t"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), "cards", "q")
    pairs = side.withColumn("game", F.col("k") - F.when(F.col("k") % 2 == 0, 1).otherwise(0))
    # One shuffle on the game, both sides from one scan, instead of a join of the sides with themselves.
    both = pairs.groupBy("game").agg(
        F.max(F.when(F.col("k") % 2 == 1, F.struct("t", "p", "s", "cards", "q"))).alias("a"),
        F.max(F.when(F.col("k") % 2 == 0, F.struct("cards", "q"))).alias("b"),
    )
    both = both.where("a is not null and b is not null and a.q <> b.q")
    return both.select(
        F.col("game").alias("game_id"), F.col("a.t").alias("battle_time"), F.col("a.p").alias("segment"), F.col("a.s").alias("mode_key"),
        F.date_format("a.t", "yyyy-MM").alias("patch"), F.col("a.cards").alias("team_card_ids"), F.col("b.cards").alias("opponent_card_ids"),
        deck_key(F.col("a.cards")).alias("team_deck_key"), deck_key(F.col("b.cards")).alias("opponent_deck_key"), (F.col("a.q") > F.col("b.q")).alias("win"),
    )


def battles_sql(universe: int | str | None = 6) -> str:
    """The same relation as common table expressions of DuckDB's SQL, ending in ``battles``."""
    card = "l_partkey" if universe is None else f"cast(l_partkey % {universe} as int)"
    return f"""
    d as (select l_orderkey k, list_sort(list(distinct {card})) cards,
                 cast(round(sum(l_quantity)) as bigint) q from lineitem group by l_orderkey),
    o as (select o_orderkey k, o_orderdate t, o_orderpriority p, o_orderstatus s, d.cards,
                 array_to_string(d.cards, ',') dk, d.q from orders join d on o_orderkey = d.k),
    battles as (select a.k game_id, a.t battle_time, a.p segment, a.s mode_key, strftime(a.t, '%Y-%m') patch,
                       a.cards team_card_ids, b.cards opponent_card_ids, a.dk team_deck_key, b.dk opponent_deck_key, a.q > b.q win
                from o a join o b on b.k = a.k + 1 and a.k % 2 = 1 where a.q <> b.q)"""


SIDES_SQL = """
    sides as (select game_id, battle_time, segment, patch, 'team' side, team_deck_key deck_key, opponent_deck_key other_key,
                     team_card_ids cards, win won from battles
              union all
              select game_id, battle_time, segment, patch, 'opponent', opponent_deck_key, team_deck_key, opponent_card_ids, not win from battles)"""


def sides(battles: DataFrame) -> DataFrame:
    """Each battle once for either side, from one scan; the opponent's result is the other way round."""
    side = lambda mine, other, name, won: F.struct(
        F.lit(name).alias("side"), F.col(f"{mine}_deck_key").alias("deck_key"), F.col(f"{other}_deck_key").alias("other_key"), F.col(f"{mine}_card_ids").alias("cards"), won.alias("won")
    )
    both = F.explode(F.array(side("team", "opponent", "team", F.col("win")), side("opponent", "team", "opponent", ~F.col("win"))))
    return battles.select("game_id", "battle_time", "segment", "patch", both.alias("s")).select("game_id", "battle_time", "segment", "patch", "s.*")


def matchup_key(a: Column, b: Column) -> Column:
    """One key for A against B and B against A."""
    return F.concat(F.least(a, b), F.lit("::"), F.greatest(a, b))


def swapped(battles: DataFrame) -> DataFrame:
    """The same battles seen from the other side: every team column for its opponent's, the result and the
    prior turned round."""
    out = {}
    for name in battles.columns:
        if name.startswith("team_") and name.replace("team_", "opponent_", 1) in battles.columns:
            other = name.replace("team_", "opponent_", 1)
            out |= {name: F.col(other), other: F.col(name)}
    if "win" in battles.columns:
        out["win"] = ~F.col("win")
    if "matrix_prior" in battles.columns:
        out["matrix_prior"] = (1 - F.col("matrix_prior")).cast(battles.schema["matrix_prior"].dataType)
    return battles.select([out.get(c, F.col(c)).alias(c) for c in battles.columns])


def predictions(battles: DataFrame) -> DataFrame:
    """A stand-in model for reports over derived battles: the larger deck is favoured."""
    p = F.lit(0.5) + F.lit(0.04) * (F.size("team_card_ids") - F.size("opponent_card_ids"))
    return battles.select("game_id", "segment", "team_deck_key", "opponent_deck_key", F.col("win").alias("target"), F.least(F.greatest(p, F.lit(0.05)), F.lit(0.95)).alias("probability"))


PREDICTIONS_SQL = """
    predictions as (select game_id, segment, team_deck_key, opponent_deck_key, win target,
                           least(greatest(0.5::double + 0.04::double * (len(team_card_ids) - len(opponent_card_ids)), 0.05::double), 0.95::double) probability
                    from battles)"""
