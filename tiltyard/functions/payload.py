"""Raw battle payloads to fact rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltyard.functions.decks import deck_key, evolution, hero, parsed_role
from tiltyard.functions.segments import LEAGUES, TOP_RANKS, TROPHIES, segment
from tiltyard.schema import FACT, PAYLOAD

LEAGUE_KEYS = ("leagueNumber", "league_number")


@dataclass(frozen=True)
class Rules:
    """What makes a battle eligible, and how it is labelled."""

    cards: int | None = 8
    modes: Sequence[str] = ()
    level_gap: float | None = None
    trophies: Sequence[int] = TROPHIES
    top_ranks: Sequence[int] = TOP_RANKS
    leagues: Sequence[int] = LEAGUES


def battle_time(text: Column) -> Column:
    """The battle log's compact time, or an ISO one; junk is null, never now."""
    compact = F.try_to_timestamp(F.when(text.rlike(r"^\d{8}T\d{6}\.\d{3}Z$"), text), F.lit("yyyyMMdd'T'HHmmss.SSS'Z'"))
    plain = F.try_to_timestamp(F.when(text.rlike(r"^\d{8}T\d{6}Z$"), text), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(compact, plain, F.when(text.rlike(r"^\d{4}-"), text).try_cast("timestamp"))


def first_positive(value, names: set[str]) -> int | None:
    """The first positive number under one of the names: an object's own keys in order, then what it holds, in
    order. Payloads come from outside and may be nested deeply, so there is a list of what is left to visit."""
    left = [value]
    while left:
        at = left.pop()
        if isinstance(at, dict):
            own = (_whole(v) for k, v in at.items() if k in names)
            if (found := next((n for n in own if n and n > 0), None)) is not None:
                return found
            left.extend(reversed(at.values()))
        elif isinstance(at, list):
            left.extend(reversed(at))
    return None


def _whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(T.IntegerType())
def buried_league(raw: pd.Series) -> pd.Series:
    """A league anywhere in the payload, for the rows that have none where it is expected."""

    def find(text) -> int | None:
        try:
            return first_positive(json.loads(text), set(LEAGUE_KEYS)) if text else None
        except ValueError:
            return None

    return raw.map(find).astype("Int32")


def known_league(b: Column) -> Column:
    """The first positive league of the paths in their order."""
    paths = [b["leagueNumber"], b["league_number"], b["currentPathOfLegendSeasonResult"]["leagueNumber"]]
    for side in ("team", "opponent"):
        paths += [F.get(b[side], 0)["leagueNumber"], F.get(b[side], 0)["league_number"]]
    return F.coalesce(*[F.when(p > 0, p) for p in paths])


def _deck(player: Column) -> dict[str, Column]:
    cards = F.coalesce(player["cards"], F.array())
    return {
        "card_ids": F.transform(cards, lambda c: c["id"]),
        "evolution_levels": F.transform(cards, lambda c: evolution(c["evolutionLevel"]).cast("tinyint")),
        "hero_levels": F.transform(cards, lambda c: _hero(c).cast("tinyint")),
        "card_roles": F.transform(cards, lambda c: parsed_role(c["rarity"], c["isChampion"], c["isHero"], _hero(c)).cast("tinyint")),
        "tower_troop_id": F.coalesce(F.get(player["supportCards"], 0)["id"], F.lit(0).cast("bigint")),
        "starting_trophies": player["startingTrophies"],
        "global_rank": player["globalRank"],
        "deck_key": deck_key(F.transform(cards, lambda c: c["id"])),
    }


def _hero(c: Column) -> Column:
    explicit = F.when(F.coalesce(c["heroLevel"], F.lit(0)) != 0, c["heroLevel"]).otherwise(c["hero_level"])
    return hero(c["evolutionLevel"], explicit)


def _level(player: Column) -> Column:
    levels = F.filter(F.transform(player["cards"], lambda c: c["level"]), lambda x: x.isNotNull())
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(levels).cast("double"), F.lit(0.0))


def game_id(time: Column, team: Column, opponent: Column) -> Column:
    """One id for a battle whichever side it was seen from: SHA-256 of the time and both sides in order."""
    side = lambda p: F.struct(F.coalesce(p["tag"], F.lit("")).alias("tag"), deck_key(F.transform(p["cards"], lambda c: c["id"])).alias("key"), F.coalesce(p["crowns"], F.lit(0)).alias("crowns"))
    both = F.array_sort(F.array(side(team), side(opponent)))
    said = F.transform(both, lambda s: F.concat(F.lit('["'), s["tag"], F.lit('","'), s["key"], F.lit('",'), s["crowns"].cast("string"), F.lit("]")))
    part = F.date_format(time, "SSSSSS")
    iso = F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))
    return F.sha2(F.concat(F.lit('["'), iso, F.lit('",['), F.concat_ws(",", said), F.lit("]]")), 256)


def fingerprint(tag: Column, battle: Column) -> Column:
    """SHA-256 of a battle as one player's log shows it."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    other = F.get(battle["opponent"], 0)
    ids = F.concat_ws(",", F.transform(F.coalesce(other["cards"], F.array()), lambda c: F.coalesce(c["id"].cast("string"), F.lit("null"))))
    return F.sha2(F.concat(F.lit("["), text(tag), F.lit(","), text(battle["battleTime"]), F.lit(","), text(other["tag"]), F.lit(",["), ids, F.lit("]]")), 256)


def parse_battles(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Fact rows of (raw, fingerprint, mode_key, battle_time, inserted_at, league_number).

    Dropped are battles that don't have one player a side, that drew, whose decks have another number of cards
    or a card without id, of modes not asked for, of sides too far apart in level (unknown levels pass), and
    without a time. Only rows of ranked mode whose league is not in its usual places are searched in Python.
    """
    names = set(rows.columns)
    given = lambda n, kind: (F.col(n) if n in names else F.lit(None)).cast(kind)
    # Exploded from an array of one, so that it is parsed once: filters and projections don't take the call along.
    b = F.from_json("raw", PAYLOAD)
    rows = rows.withColumn("b", F.explode(F.array(b)))
    base = rows.select(
        "raw", "b", given("fingerprint", "string").alias("source_fingerprint"), F.coalesce(given("mode_key", "string"), F.lit("other")).alias("mode_key"),
        F.coalesce(given("battle_time", "timestamp"), battle_time(F.col("b.battleTime"))).alias("battle_time"), given("inserted_at", "timestamp").alias("inserted_at"), given("league_number", "int").alias("sql_league"),
    )
    team, other = F.get("b.team", 0), F.get("b.opponent", 0)
    ok = (F.size("b.team") == 1) & (F.size("b.opponent") == 1) & F.col("battle_time").isNotNull()
    ok &= F.coalesce(team["crowns"], F.lit(0)) != F.coalesce(other["crowns"], F.lit(0))
    for p in (team, other):
        ok &= F.forall(F.coalesce(p["cards"], F.array()), lambda c: c["id"].isNotNull())
        if rules.cards is not None:
            ok &= F.size(p["cards"]) == rules.cards
    if rules.modes:
        ok &= F.col("mode_key").isin(*rules.modes)
    if rules.level_gap is not None:
        ok &= F.coalesce(F.abs(_level(team) - _level(other)) <= rules.level_gap, F.lit(True))
    kept = base.where(F.coalesce(ok, F.lit(False)))
    ranked = F.col("mode_key") == "ranked"
    known = F.when(F.col("sql_league") > 0, F.col("sql_league")).otherwise(known_league(F.col("b")))
    kept = kept.withColumn("known", known).withColumn("buried", buried_league(F.when(ranked & F.col("known").isNull(), F.col("raw"))))
    league = F.coalesce("known", "buried")
    exact = F.coalesce(F.concat(F.lit("ranked:league-"), league.cast("string")), F.lit("ranked:unknown"))
    label = segment(F.col("mode_key"), league, team["globalRank"], team["startingTrophies"], rules.trophies, rules.top_ranks, rules.leagues)
    values = {f"{side}_{n}": c for side, p in (("team", team), ("opponent", other)) for n, c in _deck(p).items()}
    values |= {
        "game_id": game_id(F.col("battle_time"), team, other), "segment": F.when(ranked, exact).otherwise(label), "patch": F.date_format("battle_time", "yyyy-MM"),
        "matrix_prior": F.lit(0.5), "win": F.coalesce(team["crowns"], F.lit(0)) > F.coalesce(other["crowns"], F.lit(0)),
    }
    return kept.select([values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in FACT])
