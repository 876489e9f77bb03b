"""Segments of battles: modes, leagues, trophy bands and their poolings."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default bucket edges.
TROPHIES = (0, 5000, 7000, 9000, 12000, 14000, 999999)
TOP_RANKS = (100, 1000, 10000)
LEAGUES = (1, 3, 5, 8)
# Segments that deck populations leave out.
EXCLUDED = ("ladder:top-100", "ladder:top-1000")
# Battle types of the modes.
RANKED_TYPES = ("pathoflegend", "pathoflegends")
LADDER_TYPES = ("pvp",)
# The buckets of empirical priors.
PRIOR_BUCKETS = ("ladder:0-4999", "ladder:7000-8999", "ladder:9000-11999", "ladder:12000-99998")


def checked_edges(edges) -> tuple[int, ...]:
    """League edges: none, or at least two, positive and strictly increasing."""
    if edges is None:
        return ()
    try:
        out = tuple(int(x) for x in edges)
    except (TypeError, ValueError) as e:
        raise ValueError("league edges must be integers") from e
    if out and (len(out) < 2 or out[0] <= 0 or any(a >= b for a, b in pairwise(out))):
        raise ValueError("league edges must be at least two, positive and strictly increasing")
    return out


def band(value: Column, edges, prefix: str, other: Column | None = None) -> Column:
    """``prefix`` and the half-open bucket's bounds; ``other``, or null, outside."""
    out = None
    for lo, hi in pairwise(edges):
        hit = (value >= lo) & (value < hi)
        label = F.lit(f"{prefix}{lo}-{hi - 1}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    out = F.when(F.lit(False), F.lit("")) if out is None else out
    return out if other is None else out.otherwise(other)


def ladder_band(trophies: Column, edges=TROPHIES) -> Column:
    return band(trophies, edges, "ladder:")


def ranked_segment(league: Column, edges=LEAGUES) -> Column:
    """A league's pooled segment; one outside the edges keeps its own, and none is unknown."""
    exact = F.concat(F.lit("ranked:league-"), league.cast("string"))
    return F.when(league.isNull(), "ranked:unknown").otherwise(band(league, checked_edges(edges), "ranked:league-", exact))


def segment(mode: Column, league: Column, rank: Column, trophies: Column, trophy_edges=TROPHIES, top_ranks=TOP_RANKS, league_edges=LEAGUES) -> Column:
    mode = F.lower(F.coalesce(F.when(mode != "", mode), F.lit("other")))
    top = F.lit("ladder:ranked-other")
    for upper in reversed(top_ranks):
        top = F.when(rank <= upper, f"ladder:top-{upper}").otherwise(top)
    ladder = F.when(rank > 0, top).when(trophies.isNull(), "ladder:unknown").otherwise(band(trophies, trophy_edges, "ladder:", F.lit("ladder:overflow")))
    return F.when(mode == "ranked", ranked_segment(league, league_edges)).when(mode == "ladder", ladder).otherwise(mode)


def league_of(segment_: Column) -> Column:
    """The league that an exact ranked segment names, or null."""
    return F.regexp_extract(segment_, r"^ranked:league-([0-9]+)$", 1).try_cast("int")


def pooled(segment_: Column, mode: Column | None = None, edges=LEAGUES, any_case: bool = True) -> Column:
    """Exact leagues pooled when a corpus is prepared. With ``mode`` only rows of mode ranked are touched, in
    any letter case or just lower; without it every segment that names a league."""
    league = league_of(segment_)
    new = band(league, checked_edges(edges), "ranked:league-", segment_)
    if mode is None:
        return F.when(segment_.like("ranked:league-%"), new).otherwise(segment_)
    return F.when((F.lower(mode) if any_case else mode) == "ranked", new).otherwise(segment_)


def lower_edge(segment_: Column) -> Column:
    """The lower bound that a ladder band names, or null."""
    lower = F.split_part(F.split_part(segment_, F.lit(":"), F.lit(2)), F.lit("-"), F.lit(1))
    return F.when(segment_.startswith("ladder:") & lower.rlike("^[0-9]+$"), lower.cast("int"))


def tracked(segment_: Column, least: int) -> Column:
    """Worth keeping: ranked, top ranks, and ladder bands from ``least`` on; ladder junk isn't."""
    named = segment_.startswith("ranked:") | segment_.startswith("ladder:top-")
    return named | ~segment_.startswith("ladder:") | F.coalesce(lower_edge(segment_) >= least, F.lit(False))


def realigned(segment_: Column, edges=TROPHIES) -> Column:
    """An old ladder band moved to the present one that holds its lower bound."""
    return F.coalesce(band(lower_edge(segment_), edges, "ladder:"), segment_)


def mode_of(battle_type: Column, mode_name: Column) -> Column:
    kind, name = F.lower(F.coalesce(battle_type, F.lit(""))), F.lower(F.coalesce(mode_name, F.lit("")))
    return (
        F.when(kind.isin(*RANKED_TYPES) | name.startswith("ranked"), "ranked")
        .when(kind.isin(*LADDER_TYPES) | name.startswith("ladder") | name.startswith("seasonal"), "ladder")
        .otherwise("other")
    )


def prior_bucket(segment_: Column) -> Column:
    return F.when(segment_.isin(*PRIOR_BUCKETS) | segment_.startswith("ladder:top-"), segment_).otherwise("unknown")


def served(segment_: Column, known: list[str], default: str) -> Column:
    """The segment if the model knows it, else the default."""
    return F.when(segment_.isin(known), segment_).otherwise(default)


def backfilled(segment_: Column, mode: Column, league: Column) -> Column:
    """Ranked rows without a league label get the one that was looked up, or ``ranked:unknown``; labels that
    are there stay."""
    found = F.when(league > 0, F.concat(F.lit("ranked:league-"), league.cast("string"))).otherwise("ranked:unknown")
    return F.when((mode == "ranked") & ~F.coalesce(segment_, F.lit("")).like("ranked:league-%"), found).otherwise(segment_)
