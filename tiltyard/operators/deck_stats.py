"""Deck populations: plays, orientation-balanced rates, ranks, panels and weighted statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltyard.functions.segments import EXCLUDED
from tiltyard.operators.metrics import exact_percentiles, running


def without_top_ranks(battles: DataFrame, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    return battles.where(~F.col("segment").isin(*excluded))


def play_counts(sides: DataFrame, least: int = 1, by: Sequence[str] = ("segment", "deck_key")) -> DataFrame:
    """Plays and wins of each deck over both sides, for decks of at least so many plays."""
    out = sides.groupBy(*by).agg(F.count(F.lit(1)).alias("plays"), F.sum(F.col("won").cast("bigint")).alias("wins"))
    return out.where(F.col("plays") >= least)


def oriented(sides: DataFrame, by: Sequence[str] = ("segment", "deck_key")) -> DataFrame:
    """Games and wins of each deck on either side: one conditional aggregate over exploded sides, where two
    grouped halves would need a full outer join."""
    of = lambda side: F.col("side") == side
    return sides.groupBy(*by).agg(
        *[F.count_if(of(s)).alias(f"{s}_n") for s in ("team", "opponent")],
        *[F.count_if(of(s) & F.col("won")).alias(f"{s}_wins") for s in ("team", "opponent")],
    )


def balanced_rate() -> Column:
    """The mean of both sides' win rates; null unless the deck was seen on both."""
    rate = lambda s: F.col(f"{s}_wins") / F.nullif(F.col(f"{s}_n").cast("double"), F.lit(0.0))
    return (rate("team") + rate("opponent")) / 2


def shrunk_mean(team_sum: Column, team_n: Column, other_sum: Column, other_n: Column, prior: float, strength: float) -> Column:
    """The mean of both sides' means, each drawn to the prior by half of its strength."""
    if strength < 0:
        raise ValueError("the prior's strength can't be negative")
    half = strength / 2

    def side(total: Column, n: Column) -> Column:
        return F.when(n + half <= 0, F.lit(prior)).otherwise((total + prior * half) / F.nullif((n + half).cast("double"), F.lit(0.0)))

    return (side(team_sum, team_n) + side(other_sum, other_n)) / 2


def split_stats(sides: DataFrame, cutoffs: DataFrame, by: Sequence[str] = ("segment", "deck_key")) -> DataFrame:
    """Each deck's games and wins by split and side, in one pass: cutoffs is one row (c1, c2)."""
    at = sides.crossJoin(F.broadcast(cutoffs))
    when = {"train": F.col("battle_time") <= F.col("c1"), "validation": (F.col("battle_time") > F.col("c1")) & (F.col("battle_time") <= F.col("c2")), "test": F.col("battle_time") > F.col("c2")}
    counts = [F.count_if(when["train"]).alias("train_n")]
    for split in ("validation", "test"):
        counts += [F.count_if(when[split]).alias(f"{split}_n"), F.count_if(when[split] & F.col("won")).alias(f"{split}_wins")]
        for side in ("team", "opponent"):
            here = when[split] & (F.col("side") == side)
            counts += [F.count_if(here).alias(f"{split}_{side}_n"), F.count_if(here & F.col("won")).alias(f"{split}_{side}_wins")]
    return at.groupBy(*by).agg(*counts)


def rank_within(stats: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    return stats.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def panel(plays: DataFrame, size: int) -> DataFrame:
    """A segment's most-played decks with weights that sum to one."""
    top = rank_within(plays, "segment", F.desc("plays"), F.col("deck_key")).where(F.col("rank") <= size)
    return top.withColumn("weight", F.col("plays") / F.sum("plays").over(Window.partitionBy("segment")))


def screen_panel(panel_: DataFrame, size: int) -> DataFrame:
    """Panel decks at evenly spaced ranks, first and last included, their weights made to sum to one."""
    n = F.max("rank").over(Window.partitionBy("segment"))
    place = F.col("rank") - 1
    steps = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(float(max(1, size - 1)))))
    chosen = panel_.withColumn("n", n).where((F.col("n") <= size) | F.array_contains(steps, place.cast("bigint")))
    return chosen.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("segment"))).drop("n")


def usage(plays: DataFrame, decks: int, cards: int) -> DataFrame:
    """A segment's card pool: the cards most used, by plays, over its most-played decks."""
    top = rank_within(plays, "segment", F.desc("plays"), F.col("deck_key")).where(F.col("rank") <= decks)
    used = top.select("segment", "plays", F.explode(F.split("deck_key", ",")).alias("c")).groupBy("segment", F.col("c").cast("bigint").alias("card")).agg(F.sum("plays").alias("uses"))
    return rank_within(used, "segment", F.desc("uses"), F.col("card")).where(F.col("rank") <= cards)


# Weighted statistics. The three percentile rules are different on purpose. ---------------------------


def _cumulative(df: DataFrame, value: str, weight: str | None, by: Sequence[str]) -> DataFrame:
    """One row a distinct value with the share of weight up to it; values are summed before the window."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    sums = df.groupBy(*by, value).agg(w.alias("w"))
    if not by:
        return running(sums, [value], "w", "_before").withColumn("share", (F.col("_before") + F.col("w")) / F.col("_total")).drop("_before", "_total")
    whole = Window.partitionBy(*by)
    return sums.withColumn("share", F.sum("w").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(whole))


def weighted_percentiles(df: DataFrame, value: str, weight: str | None, shares: Sequence[float], by: Sequence[str] = (), clamp: bool = False) -> DataFrame:
    """The least value whose share of weight reaches each asked share. ``clamp``: the largest value stands for
    shares that rounding leaves unreached; without it they are null."""
    at = _cumulative(df, value, weight, by)
    picks = [F.min(F.when(F.col("share") >= s, F.col(value))) for s in shares]
    picks = [F.coalesce(p, F.max(value)) for p in picks] if clamp else picks
    return at.groupBy(*by).agg(*[p.alias(name(s)) for s, p in zip(shares, picks)])


def linear_percentiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, mean and population deviation."""
    picks = exact_percentiles(df, F.col(value), {name(s): s for s in shares}, by)
    rest = df.groupBy(*[F.col(b).alias(f"_of_{b}") for b in by]).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    out = picks.join(rest, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]) if by else picks.crossJoin(F.broadcast(rest))
    return out.drop(*[f"_of_{b}" for b in by])


def name(share: float) -> str:
    digits = f"{share:.3f}"[2:]
    return f"p{digits[:2] if digits.endswith('0') else digits}"


def changes(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """What a value gained since the row before it of its group; the first has none. For short series: a group's rows
    are one task's."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def largest(df: DataFrame, value: str, rows: int, *ties: str) -> DataFrame:
    """The rows of the largest values of either sign: a top-k."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(F.round(F.abs(value), 9)), *ties).limit(rows)


def share_below(df: DataFrame, value: str, reference: DataFrame, ref_value: str) -> DataFrame:
    """For each row, the share of reference values below it: counts of distinct values, a running sum and a
    join on the value, instead of every row against all the reference."""
    mine = df.groupBy(F.col(value).alias("v")).agg(F.lit(0).cast("bigint").alias("c")).withColumn("mine", F.lit(True))
    theirs = reference.groupBy(F.col(ref_value).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("mine", F.lit(False))
    per = mine.union(theirs).groupBy("v").agg(F.sum("c").alias("c"), F.max("mine").alias("mine"))
    at = running(per, ["v"], "c", "_before").withColumn("below", F.col("_before") / F.col("_total")).where("mine")
    return df.join(at.select(F.col("v").alias("r_v"), "below"), F.col(value) == F.col("r_v"), "left").drop("r_v")


def bands(df: DataFrame, value: str, edges: Sequence[float], measures: Sequence[Column]) -> DataFrame:
    """Rows by half-open bands of a value, the last one closed above."""
    label = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (F.col(value) >= lo) & ((F.col(value) <= hi) if i == len(edges) - 2 else (F.col(value) < hi))
        label = F.when(inside, i) if label is None else label.when(inside, i)
    return df.withColumn("band", label).where("band is not null").groupBy("band").agg(*measures)
