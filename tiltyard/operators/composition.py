"""What decks are made of, by a catalogue of cards (card, roles, kind, targets, transport, elixir)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltyard.functions.decks import slug

_f = F.col

# The candidate rules and the two envelopes, over a deck's features.
RULES = {
    "win_conditions >= 1": "win_conditions >= 1",
    "win_conditions >= 1 and <= 3": "win_conditions between 1 and 3",
    "any_spells >= 1": "any_spells >= 1",
    "any_spells >= 2": "any_spells >= 2",
    "small_spells >= 1": "small_spells >= 1",
    "anti_air >= 2": "anti_air >= 2",
    "anti_air >= 3": "anti_air >= 3",
    "cheap_cards >= 2": "cheap_cards >= 2",
    "cheap_cards >= 3": "cheap_cards >= 3",
    "cheapest <= 2": "cheapest <= 2",
    "average_elixir <= 4.5": "average_elixir <= 4.5D",
    "average_elixir <= 5.0": "average_elixir <= 5.0D",
    "average_elixir in [2.4, 4.6]": "average_elixir between 2.4D and 4.6D",
    "splash >= 1": "splash >= 1",
    "tank_killers >= 1": "tank_killers >= 1",
}
WIDE = "anti_air >= 2 and average_elixir <= 5.0D and buildings <= 2 and distinct_roles >= 8"
TIGHT = WIDE + " and cheap_cards >= 2 and any_spells >= 1"


def with_catalogue(decks: DataFrame, catalogue: DataFrame, key: Sequence[str] = ("deck_key",), cards: str = "cards") -> DataFrame:
    """A row a deck's card with what the catalogue knows; the catalogue is a small dimension."""
    each = decks.select(*key, F.explode(cards).alias("_card"))
    return each.join(F.broadcast(catalogue), _f("_card") == _f("card"), "left")


def resolve(names: DataFrame, catalogue: DataFrame, name: str = "name", card: str = "card") -> DataFrame:
    """Each name's card by its slug (the least of several), or null; spelling in case, spaces and hyphens is one."""
    known = catalogue.groupBy(slug(F.col(name)).alias("_slug")).agg(F.min(card).alias(card))
    return names.withColumn("slug", slug(F.col(name))).join(known, F.col("slug") == F.col("_slug"), "left").drop("_slug")


def features(decks: DataFrame, catalogue: DataFrame, key: Sequence[str] = ("deck_key",), cards: str = "cards") -> DataFrame:
    """Thirteen numbers of a deck; cards without elixir count in none of the elixir ones."""
    each = with_catalogue(decks, catalogue, key, cards)
    role = lambda r: F.coalesce(F.array_contains("roles", r), F.lit(False))
    count = lambda c, n: F.count_if(c).alias(n)
    spell = F.coalesce(_f("kind") == "spell", F.lit(False))
    cost = F.when(_f("elixir") > 0, _f("elixir"))
    air = F.coalesce(_f("targets") == "air-and-ground", F.lit(False)) | role("anti-air") | (spell & ~role("spell-utility"))
    out = each.groupBy(*key).agg(
        count(role("win-condition"), "win_conditions"), count(role("spell-small"), "small_spells"), count(spell, "any_spells"),
        count(role("spell-medium"), "medium_spells"), count(role("spell-heavy"), "heavy_spells"), count(air, "anti_air"),
        count(F.coalesce(_f("kind") == "building", F.lit(False)), "buildings"), count(role("splash-damage"), "splash"), count(role("tank-killer"), "tank_killers"),
        count(cost <= 3, "cheap_cards"), F.coalesce(F.min(cost), F.lit(0)).cast("bigint").alias("cheapest"), F.coalesce(F.avg(cost), F.lit(0.0)).alias("average_elixir"),
        F.size(F.array_distinct(F.flatten(F.collect_set("roles")))).cast("bigint").alias("distinct_roles"), F.count_if(_f("card").isNull()).alias("unknown_cards"),
    )
    return out


def rule_rates(features_: DataFrame, plays: str = "plays", by: Sequence[str] = ()) -> DataFrame:
    """Each rule's pass rate by deck and by play; all rules in one pass."""
    tests = F.array(*[F.struct(F.lit(label).alias("rule"), F.expr(test).alias("hit")) for label, test in RULES.items()])
    each = features_.select(*by, F.col(plays).alias("_plays"), F.explode(tests).alias("t"))
    hit = F.col("t.hit")
    return each.groupBy(*by, F.col("t.rule").alias("rule")).agg(F.avg(hit.cast("int")).alias("deck_pass_rate"), (F.coalesce(F.sum(F.when(hit, _f("_plays"))), F.lit(0)) / F.sum("_plays")).alias("play_pass_rate"))


def admitted(envelope: str) -> Column:
    """Decks under an envelope; one with an unknown card is admitted, not judged."""
    return (F.col("unknown_cards") > 0) | F.expr(envelope)


def profile(decks: DataFrame, catalogue: DataFrame, roles: Sequence[str], kinds: Sequence[str], key: Sequence[str] = ("deck_key",), cards: str = "cards") -> DataFrame:
    """A deck's functional profile: cards by role and kind, reach, and the shape of its elixir."""
    each = with_catalogue(decks, catalogue, key, cards)
    cost = F.when(_f("elixir") > 0, _f("elixir").cast("double"))
    counts = [F.count_if(F.array_contains("roles", r)).alias(f"role:{r}") for r in roles] + [F.count_if(_f("kind") == k).alias(f"kind:{k}") for k in kinds]
    bands = [F.count_if(cost.between(lo, hi)).alias(f"elixir:{lo}-{hi}") for lo, hi in ((0, 2), (3, 3), (4, 4), (5, 5), (6, 99))]
    return each.groupBy(*key).agg(
        *counts, F.count_if(F.lower("targets").contains("air")).alias("hits_air"), F.count_if(F.lower("transport") == "air").alias("air_unit"),
        F.coalesce(F.avg(cost), F.lit(0.0)).alias("elixir_mean"), F.coalesce(F.stddev_pop(cost), F.lit(0.0)).alias("elixir_std"), *bands,
    )


def nearest(vectors: DataFrame, reference: DataFrame, k: int = 25, id_: str = "id", vector: str = "vector", block: int = 4096) -> DataFrame:
    """Mean Euclidean distance of each vector to its ``k`` nearest in a reference, by blocks of matrix products.

    The reference is cut into blocks, each vector meets each block once and brings its k nearest there; the
    merge takes the k least of those. Nothing larger than a block meets a batch.
    """
    import numpy as np
    import pyarrow as pa

    n = reference.count()
    blocks = max(1, -(-n // block))
    ref = reference.select(F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"), F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        dim = len(left["v"][0])
        a, b = (t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim) for t in (left, right))
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        got, at = [], []
        for lo in range(0, len(a), 1024):
            part = a[lo : lo + 1024]
            d = np.maximum((part * part).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * part @ b.T, 0)
            d[ids[lo : lo + 1024, None] == other[None, :]] = np.inf
            m = min(k, d.shape[1])
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            exact = np.sqrt(((part[:, None, :] - b[near]) ** 2).sum(axis=2))
            exact[~np.isfinite(np.take_along_axis(d, near, axis=1))] = np.nan
            got.append(exact.ravel())
            at.append(np.repeat(ids[lo : lo + 1024], m))
        values, names = np.concatenate(got), np.concatenate(at)
        keep = ~np.isnan(values)
        return pa.table({"id": pa.array(names[keep]), "d": pa.array(values[keep])})

    near = own.groupBy("block").cogroup(ref.groupBy("block")).applyInArrow(meet, "id long, d double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    return near.withColumn("place", place).where(F.col("place") <= k).groupBy("id").agg(F.avg("d").alias("distance"))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their deviation (one where that is zero)."""
    ends = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(ends))
    return out.select(*[F.col(c) for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in columns])
