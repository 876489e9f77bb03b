"""Rows of battles as the arrays a model reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.functions.cards import elixir
from tiltyard.functions.decks import fixed, normal_forms
from tiltyard.operators.prepare import cards_of, vocabulary
from tiltyard.sources.battles import swapped


@dataclass
class Vocabularies:
    """Index of each value from 1; 0 is padding and whatever isn't known. As many entries as there are cards,
    towers, segments and patches."""

    cards: dict[int, int]
    towers: dict[int, int]
    segments: dict[str, int]
    patches: dict[str, int]

    @classmethod
    def of(cls, train: DataFrame) -> Vocabularies:
        towers = train.select(F.explode(F.array("team_tower_troop_id", "opponent_tower_troop_id")).alias("tower"))
        read = lambda df, c: {r[c]: r["index"] for r in vocabulary(df, c).collect()}
        return cls(read(cards_of(train), "card"), read(towers, "tower"), read(train, "segment"), read(train, "patch"))


def looked_up(values: dict, key: Column, kind: str) -> Column:
    if not values:
        return F.lit(0)
    table = F.create_map(*[F.lit(x).cast(kind) if i % 2 == 0 else F.lit(x) for k, v in values.items() for i, x in enumerate((k, v))])
    return F.coalesce(F.element_at(table, key.cast(kind)), F.lit(0))


def encode(battles: DataFrame, v: Vocabularies, size: int = 8) -> DataFrame:
    """Card, evolution, hero, role and elixir arrays of either side, cut or filled to ``size``; indexes of towers,
    segment and patch; prior and target. Old form masks are decoded. All in the row: no join, no Python."""
    out = {"game_id": F.col("game_id")}
    for side in ("team", "opponent"):
        ids = F.col(f"{side}_card_ids")
        forms = normal_forms(*[F.col(f"{side}_{n}") for n in ("evolution_levels", "hero_levels", "card_roles")])
        out |= {
            f"{side}_cards": fixed(F.transform(ids, lambda c: looked_up(v.cards, c, "bigint")), size),
            **{f"{side}_{n}": fixed(forms[n], size) for n in ("evolution", "hero", "role")},
            f"{side}_elixir": fixed(F.transform(ids, elixir), size),
            f"{side}_tower": looked_up(v.towers, F.col(f"{side}_tower_troop_id"), "bigint"),
        }
    out |= {"segment": looked_up(v.segments, F.col("segment"), "string"), "patch": looked_up(v.patches, F.col("patch"), "string"), "prior": F.col("matrix_prior").cast("float"), "target": F.col("win").cast("float")}
    return battles.select([c.alias(n) for n, c in out.items()])


def both_directions(battles: DataFrame, v: Vocabularies, size: int = 8) -> DataFrame:
    """Every battle from either side, the swapped one marked."""
    return encode(battles, v, size).withColumn("swapped", F.lit(False)).unionByName(encode(swapped(battles), v, size).withColumn("swapped", F.lit(True)))
