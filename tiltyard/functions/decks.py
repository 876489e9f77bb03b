"""Decks: keys, forms, roles, fixed-length arrays, and groups of cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL, CHAMPION, HERO = 1, 2, 3


def deck_key(ids: Column) -> Column:
    """The ids in ascending numeric order, with commas."""
    return F.concat_ws(",", F.transform(F.array_sort(ids), lambda x: x.cast("string")))


def deck_cards(key: Column) -> Column:
    return F.transform(F.split(key, ","), lambda x: x.cast("bigint"))


def evolution(flags: Column) -> Column:
    """Bit 1 of the form mask."""
    return F.greatest(F.coalesce(flags, F.lit(0)), F.lit(0)).bitwiseAND(1).cast("int")


def hero(flags: Column, explicit: Column) -> Column:
    """An explicit level, where it is positive, and else bit 2 of the form mask."""
    level = F.greatest(F.coalesce(explicit, F.lit(0)), F.lit(0)).cast("int")
    bit = F.when(F.greatest(F.coalesce(flags, F.lit(0)), F.lit(0)).bitwiseAND(2) > 0, 1).otherwise(0)
    return F.when(level > 0, level).otherwise(bit).cast("int")


def parsed_role(rarity: Column, is_champion: Column, is_hero: Column, hero_level: Column) -> Column:
    """Champion comes before hero when a battle is parsed."""
    rarity = F.lower(F.coalesce(rarity, F.lit("")))
    return (
        F.when((rarity == "champion") | F.coalesce(is_champion, F.lit(False)), CHAMPION)
        .when((rarity == "hero") | F.coalesce(is_hero, F.lit(False)) | (hero_level > 0), HERO)
        .otherwise(NORMAL)
    )


def served_role(card_id: Column, hero_level: Column, champions: list[int]) -> Column:
    """Hero comes before champion when a request is served or a row encoded."""
    return F.when(hero_level > 0, HERO).when(card_id.isin(champions), CHAMPION).otherwise(NORMAL)


def fixed(values: Column, size: int = 8) -> Column:
    """Cut or filled with zeros to ``size``."""
    return F.slice(F.concat(F.coalesce(values, F.array()), F.array_repeat(F.lit(0), size)), 1, size)


def normal_forms(evolutions: Column, heroes: Column, roles: Column) -> Column:
    """Arrays as structs (evolution, hero, role) with old masks decoded: a hero bit counts beside a hero level,
    and any hero has the hero's role."""
    zipped = F.arrays_zip(evolutions.alias("e"), heroes.alias("h"), roles.alias("r"))
    level = lambda x: F.greatest(F.greatest(F.coalesce(x["h"], F.lit(0)), F.lit(0)).cast("int"), F.when(F.greatest(x["e"], F.lit(0)).bitwiseAND(2) > 0, 1).otherwise(0))
    return F.transform(zipped, lambda x: F.struct(evolution(x["e"]).alias("evolution"), level(x).alias("hero"), F.when(level(x) > 0, HERO).otherwise(x["r"]).cast("int").alias("role")))


def pairs(cards: Column) -> Column:
    """All pairs (a, b), a before b, of a deck's sorted cards."""
    deck = F.array_sort(cards)
    return F.flatten(F.transform(deck, lambda a, i: F.transform(F.slice(deck, i + 2, F.greatest(F.size(deck) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def groups(cards: Column, size: int) -> Column:
    """All groups of ``size`` of a deck's cards, each as its cards in order with commas; a deck has at most
    C(8, 4) = 70 of them. ``size`` 1 gives the cards."""
    deck = F.array_sort(cards)

    def after(chosen: Column | None, start: Column, left: int) -> Column:
        def extend(card: Column, at: Column) -> Column:
            name = card.cast("string") if chosen is None else F.concat_ws(",", chosen, card.cast("string"))
            here = start + at + 1
            return F.array(name) if left == 1 else after(name, here, left - 1)

        rest = F.slice(deck, start + 1, F.greatest(F.size(deck) - start, F.lit(0)))
        return F.flatten(F.transform(rest, extend))

    return after(None, F.lit(0), size)


def legal(cards: Column, champions: list[int], size: int = 8) -> Column:
    """So many different cards and at most one champion."""
    return (F.size(F.array_distinct(cards)) == size) & (F.size(cards) == size) & (F.size(F.array_intersect(cards, F.array(*[F.lit(c).cast("bigint") for c in champions]))) <= 1)


def tag(raw: Column) -> Column:
    """A player's tag: trimmed, upper case, no letter O, one leading #; an empty one stays empty."""
    clean = F.ltrim(F.replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.lit("O"), F.lit("0")), F.lit("#"))
    return F.when(clean == "", "").otherwise(F.concat(F.lit("#"), clean))


def slug(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))
