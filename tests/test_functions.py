import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltyard.functions import cards, decks, labels, payload, segments


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def battle(team_cards=None, other_cards=None, crowns=(3, 1), **more):
    card = lambda i, **x: {"id": 26000000 + i, "level": 11} | x
    team = team_cards or [card(0, isChampion=True, heroLevel=1), card(1, evolutionLevel=1), card(2, evolutionLevel=2), card(3, evolutionLevel=3), *[card(i) for i in range(4, 8)]]
    other = other_cards or [card(i) for i in range(8, 16)]
    side = lambda tag, cs, n: [{"tag": tag, "crowns": n, "startingTrophies": 7200, "cards": cs, "supportCards": [{"id": 159000000}]}]
    return {"battleTime": "20260601T120000.000Z", "team": side("#A", team, crowns[0]), "opponent": side("#B", other, crowns[1])} | more


def parsed(spark, *battles, mode="ladder", league=None, **rules):
    rows = [(json.dumps(b), str(i), mode, league) for i, b in enumerate(battles)]
    return payload.parse_battles(spark.createDataFrame(rows, "raw string, fingerprint string, mode_key string, league_number int"), payload.Rules(**rules)).collect()


def test_forms_and_roles(spark):
    (r,) = parsed(spark, battle())
    assert r.team_evolution_levels == [0, 1, 0, 1, 0, 0, 0, 0]
    assert r.team_hero_levels == [1, 0, 1, 1, 0, 0, 0, 0]
    assert r.team_card_roles == [2, 1, 3, 3, 1, 1, 1, 1]
    assert r.team_tower_troop_id == 159000000 and r.win and r.patch == "2026-06" and r.segment == "ladder:7000-8999"
    assert r.battle_time == datetime.datetime(2026, 6, 1, 12) and abs(r.matrix_prior - 0.5) < 1e-9


def test_same_game_from_both_sides(spark):
    b = battle()
    back = b | {"team": b["opponent"], "opponent": b["team"]}
    one, two = parsed(spark, b, back)
    assert one.game_id == two.game_id and one.win != two.win
    import hashlib

    sides = sorted([("#A", one.team_deck_key, 3), ("#B", one.opponent_deck_key, 1)])
    said = json.dumps(["2026-06-01T12:00:00+00:00", sides], separators=(",", ":"))
    assert one.game_id == hashlib.sha256(said.encode()).hexdigest()


def test_ineligible_battles(spark):
    seven = battle(team_cards=[{"id": i} for i in range(7)])
    nameless = battle(team_cards=[{"level": 1}] * 8)
    far = battle(team_cards=[{"id": i, "level": 1} for i in range(8)])
    assert parsed(spark, battle(crowns=(1, 1)), seven, nameless, battle(battleTime="junk"), {"team": []}, {}) == []
    assert len(parsed(spark, seven, cards=None)) == 1
    assert parsed(spark, far, level_gap=2) == [] and len(parsed(spark, far)) == 1
    assert len(parsed(spark, battle(team_cards=[{"id": i} for i in range(8)]), level_gap=2)) == 1  # unknown levels pass
    assert parsed(spark, battle(), modes=["ranked"]) == []


@pytest.mark.parametrize(
    "more, league, segment",
    [({"leagueNumber": 4}, None, "ranked:league-4"), ({"leagueNumber": 4}, 6, "ranked:league-6"), ({}, None, "ranked:unknown"), ({"x": {"y": [{"league_number": 0}, {"league_number": "5"}]}}, None, "ranked:league-5"), ({"currentPathOfLegendSeasonResult": {"leagueNumber": 2}}, None, "ranked:league-2")],
)
def test_ranked_league(spark, more, league, segment):
    (r,) = parsed(spark, battle(**more), mode="ranked", league=league)
    assert r.segment == segment


def test_times(spark):
    rows = [("20260601T120000.000Z",), ("2026-06-01T12:00:00Z",), ("20260601T120000Z",), ("junk",), (None,), ("",)]
    got = values(spark, rows, "t string", payload.battle_time(F.col("t")))
    assert [x is not None for (x,) in got] == [True, True, True, False, False, False]
    assert len({x for (x,) in got[:3]}) == 1


def test_segments(spark):
    rows = [("Ranked", 4, None, None), ("ranked", 7, None, None), ("ranked", 9, None, None), ("ranked", None, None, None), ("ladder", None, 50, 8000), ("ladder", None, 99999, 1), ("ladder", None, 0, 8000), ("ladder", None, None, None), ("ladder", None, None, 10**6), ("Event", None, None, None), (None, None, None, None)]
    got = values(spark, rows, "m string, l int, r int, t int", segments.segment(*[F.col(c) for c in "mlrt"]))
    assert [x for (x,) in got] == ["ranked:league-3-4", "ranked:league-5-7", "ranked:league-9", "ranked:unknown", "ladder:top-100", "ladder:ranked-other", "ladder:7000-8999", "ladder:unknown", "ladder:overflow", "event", "other"]


def test_pooling_is_idempotent(spark):
    rows = [(s,) for s in ("ranked:league-1", "ranked:league-4", "ranked:league-7", "ranked:unknown", "ladder:0-4999", "ranked:league-3-4")]
    once = values(spark, rows, "s string", segments.pooled(F.col("s")))
    assert [x for (x,) in once] == ["ranked:league-1-2", "ranked:league-3-4", "ranked:league-5-7", "ranked:unknown", "ladder:0-4999", "ranked:league-3-4"]
    assert values(spark, once, "s string", segments.pooled(F.col("s"))) == once


def test_tracking_and_old_bands(spark):
    rows = [("ranked:unknown", True), ("ladder:top-100", True), ("ladder:5000-6999", True), ("ladder:0-4999", False), ("ladder:unknown", False), ("ladder:overflow", False), ("event", True)]
    got = values(spark, rows, "s string, e boolean", segments.tracked(F.col("s"), 5000), "e")
    assert all(a == b for a, b in got)
    assert values(spark, [("ladder:12000-99998",)], "s string", segments.realigned(F.col("s"))) == [("ladder:12000-13999",)]


@pytest.mark.parametrize("edges", [[1], [0, 2], [3, 3], [5, 2], ["x", 2]])
def test_bad_league_edges(edges):
    with pytest.raises(ValueError):
        segments.checked_edges(edges)


def test_label_boundaries(spark):
    rows = [(p,) for p in (0.39, 0.4, 0.45, 0.55, 0.56, 0.6, 0.61)]
    got = values(spark, rows, "p double", labels.five(F.col("p")), labels.served(F.col("p")), labels.meta(F.col("p")))
    assert [g[0] for g in got] == ["very_bad", "bad", "neutral", "neutral", "good", "good", "very_good"]
    assert [g[1] for g in got][2:4] == ["bad", "good"] and [g[2] for g in got][2:4] == ["neutral", "neutral"]


def test_tags(spark):
    rows = [(" #2pooly ",), ("##abc",), ("",), (None,), ("xyz",)]
    assert [x for (x,) in values(spark, rows, "t string", decks.tag(F.col("t")))] == ["#2P00LY", "#ABC", "", "", "#XYZ"]


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=0, max_size=9), st.integers(1, 4))
def test_groups_are_combinations(spark, deck, size):
    from itertools import combinations

    rows = [(sorted(deck),)]
    ((got,),) = values(spark, rows, "c array<int>", decks.groups(F.col("c"), size))
    assert got == [",".join(map(str, g)) for g in combinations(sorted(deck), size)]
    ((pairs,),) = values(spark, rows, "c array<int>", decks.pairs(F.col("c")))
    assert [tuple(p) for p in pairs] == list(combinations(sorted(deck), 2))


def test_old_form_flags(spark):
    ((got,),) = values(spark, [([3, 0, 2, 1], [0, 2, 0, 0], [1, 1, 1, 2])], "e array<int>, h array<int>, r array<int>", decks.normal_forms(F.col("e"), F.col("h"), F.col("r")))
    assert [tuple(x) for x in got] == [(1, 1, 3), (0, 2, 3), (0, 1, 3), (1, 0, 2)]


def test_card_numbers(spark):
    assert len(cards.FIELDS) == 45 and len(cards.ELIXIR) == 133
    rows = [(26000065, "troop", "mini_tank", ["champion"], 3, 3, 3, 2, 1, {"damage": -1}, (1, ["ability_dash"]), None, None), (26000000, "troop", "mini_tank", [], 3, 3, 3, 2, 1, None, None, (2, ["ability_control"]), (2, ["evo_shield"]))]
    known = cards.numbers(spark.createDataFrame(rows, cards.CATALOGUE))
    asked = spark.createDataFrame([(c, e, h) for c in (0, 26000000, 26000065, 5) for e in (False, True) for h in (False, True)], "card bigint, evolved boolean, hero boolean")
    got = {(r.card, r.evolved, r.hero): dict(zip(cards.FIELDS, r.numbers)) for r in cards.form_numbers(asked, known).collect()}
    assert not any(got[0, True, True].values()) and got[5, False, False]["type:unknown"] == 1
    knight = got[26000000, False, False]
    assert knight["tag:mini_tank"] == 1 and knight["state:ability_active"] == 0 and abs(knight["num:hitpoints"] - 0.6) < 1e-6
    assert got[26000000, False, True]["ability:ability_control"] == 1 and got[26000000, True, False]["evo:evo_shield"] == 1
    champion = got[26000065, False, False]
    assert champion["state:ability_active"] == 1 and champion["tag:champion"] == 1 and abs(champion["num:damage"] - 0.55) < 1e-6
