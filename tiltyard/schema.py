"""The fact table of battles and the raw payload it is parsed from."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _B, _I, _S = T.LongType(), T.ByteType(), T.IntegerType(), T.StringType()
_TIME, _TRUE = T.TimestampType(), T.BooleanType()


def _both(name: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(f"{side}_{name}", kind) for side in ("team", "opponent")]


#: One row a battle.
FACT = T.StructType(
    [
        *[T.StructField(n, k) for n, k in (("game_id", _S), ("source_fingerprint", _S), ("battle_time", _TIME), ("inserted_at", _TIME), ("mode_key", _S), ("segment", _S), ("patch", _S))],
        *_both("card_ids", T.ArrayType(_L)),
        *_both("evolution_levels", T.ArrayType(_B)),
        *_both("hero_levels", T.ArrayType(_B)),
        *_both("card_roles", T.ArrayType(_B)),
        *_both("tower_troop_id", _L),
        *_both("starting_trophies", _I),
        *_both("global_rank", _I),
        *_both("deck_key", _S),
        T.StructField("matrix_prior", T.FloatType()),
        T.StructField("win", _TRUE),
    ]
)

_CARD = "id BIGINT, level INT, rarity STRING, evolutionLevel INT, heroLevel INT, hero_level INT, isChampion BOOLEAN, isHero BOOLEAN"


def _struct(fields: str) -> str:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            parts.append(f"{name}: {kind}")
            start = i + 1
    return f"STRUCT<{', '.join(parts)}>"


_CARDS = f"ARRAY<{_struct(_CARD)}>"
_SIDE = f"ARRAY<{_struct(f'tag STRING, crowns INT, startingTrophies INT, globalRank INT, leagueNumber INT, league_number INT, cards {_CARDS}, supportCards ARRAY<STRUCT<id: BIGINT>>')}>"

#: A battle as the battle log has it; unknown fields are ignored, missing ones are null.
PAYLOAD = (
    "type STRING, battleTime STRING, gameMode STRUCT<name: STRING>, leagueNumber INT, league_number INT, "
    f"currentPathOfLegendSeasonResult STRUCT<leagueNumber: INT>, team {_SIDE}, opponent {_SIDE}"
)
