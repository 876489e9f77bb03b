import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltyard.operators import composition, cooccurrence, correction, deck_stats, metrics, neighbours, prepare, prior, unseen
from tiltyard.plans import model, search
from tiltyard.sources.battles import sides, swapped


def test_unseen_levels(spark):
    schema = "game_id string, team_deck_key string, opponent_deck_key string"
    train = spark.createDataFrame([("1", "deck-a", "deck-b"), ("2", "deck-c", "deck-d")], schema)
    test = spark.createDataFrame([("seen", "deck-b", "deck-a"), ("known", "deck-a", "deck-c"), ("one", "deck-a", "deck-x"), ("two", "deck-y", "deck-z")], schema)
    marked = unseen.mark_unseen(train, test).cache()
    assert marked.count() == 4
    assert {r.level: r.rows for r in unseen.levels(marked).collect()} == {"all_unseen_matchups": 3, "known_decks_new_matchup": 1, "one_new_deck": 1, "two_new_decks": 1}
    assert [r.game_id for r in unseen.level_rows(marked, "two_new_decks").collect()] == ["two"]
    assert unseen.strict_split(marked).first().excluded_seen_rows == 1


def test_noise_floor(spark):
    rows = [(y, "AAAABBBB"[i], 0.5) for i, y in enumerate((1, 1, 1, 0, 0, 0, 0, 1))]
    df = spark.createDataFrame(rows, "target int, key string, model double")
    r = metrics.noise_floor(df, "key", 4).first()
    assert (r.irreducible_brier, r.supported_matchups, r.supported_rows) == (0.1875, 2, 8)
    r = metrics.noise_floor(df, "key", 9).first()
    assert r.supported_rows == 0 and r.irreducible_brier is None and r.coverage == 0


def test_shrunk_mean(spark):
    row = spark.createDataFrame([(8, 10, 0, 0)], "a int, n int, b int, m int")
    rate = lambda strength: deck_stats.shrunk_mean(F.col("a"), F.col("n"), F.col("b"), F.col("m"), 0.5, strength)
    got = row.select(rate(20.0), rate(0.0)).first()
    assert got[0] == pytest.approx(0.575) and got[1] == pytest.approx(0.65)
    with pytest.raises(ValueError):
        rate(-1.0)


def test_calibration(spark):
    p = [(i, i % 2, i / 99) for i in range(100)]
    df = spark.createDataFrame(p, "id int, target int, probability double")
    table = metrics.quantile_calibration(df, "id", 10).collect()
    assert sorted(r["count"] for r in table) == [10] * 10
    fixed = {r.bin: r["count"] for r in metrics.fixed_calibration(spark.createDataFrame([(1, 0.0), (0, 0.3), (1, 0.7), (1, 1.0), (0, 0.9)], "target int, probability double"), 10).collect()}
    assert fixed == {0: 1, 3: 1, 7: 1, 9: 2}
    assert metrics.calibration_line(df.where("target = 1")) == (None, None)
    assert metrics.scalar_metrics(df.where("target = 1")).first().auc is None


def test_overconfident_slope(spark):
    rng = np.random.default_rng(1)
    true = rng.uniform(0.2, 0.8, 20000)
    y = rng.uniform(size=20000) < true
    z = 2 * np.log(true / (1 - true))
    df = spark.createDataFrame(pd.DataFrame({"id": range(20000), "target": y.astype(int), "probability": 1 / (1 + np.exp(-z))}))
    slope, intercept = metrics.calibration_line(df)
    assert 0.4 < slope < 0.6 and abs(intercept) < 0.1
    for r in metrics.bootstrap(df, "id", 60).collect():
        assert r.low <= r.high and r.std > 0
    brier = ((1 / (1 + np.exp(-z)) - y) ** 2).mean()
    interval = {r.metric: (r.low, r.high) for r in metrics.bootstrap(df, "id", 60).collect()}["brier_score"]
    assert interval[0] < brier < interval[1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sampled_from([0.1, 0.3, 0.5, 0.9])), min_size=2, max_size=30))
def test_auc_is_pairs(spark, rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    got = metrics.auc(spark.createDataFrame(rows, "target boolean, probability double")).first().auc
    if not pos or not neg:
        assert got is None
    else:
        assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_dedup(spark):
    schema = "game_id string, value int"
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema)
    first = prepare.first_of(one, ["game_id"], F.col("value"))
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 3)]
    two = spark.createDataFrame([("b", 4), ("c", 5)], schema)
    assert [tuple(r) for r in prepare.new_rows(two, first, "game_id", F.col("value")).collect()] == [("c", 5)]
    with pytest.raises(ValueError):
        prepare.history(one.where("false").withColumn("t", F.current_timestamp()), "t", 3)


def test_splits_are_disjoint(spark):
    df = spark.range(1000).select(F.col("id").alias("game_id"), F.timestamp_seconds(F.col("id") * 60).alias("battle_time"))
    out = prepare.split(df, prepare.cutoffs(df))
    ends = {r["split"]: (r.n, r.lo, r.hi) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.min("battle_time").alias("lo"), F.max("battle_time").alias("hi")).collect()}
    assert [ends[s][0] for s in ("train", "validation", "test")] == [700, 150, 150]
    assert ends["train"][2] < ends["validation"][1] and ends["validation"][2] < ends["test"][1]


def test_card_weights(spark):
    got = {r.card: (r.n, r.weight) for r in prepare.inverse_weights(spark.createDataFrame([(100, 1000), (200, 10)], "card int, n int"), 0.5, 100.0).collect()}
    assert sum(n * w for n, w in got.values()) / 1010 == pytest.approx(1) and got[200][1] > got[100][1]


def test_embeddings_keep_families(spark):
    decks = spark.createDataFrame([([1, 2, 3],)] * 50 + [([4, 5, 6],)] * 50 + [([1, 4],)] * 2, "cards array<int>")
    names, v = cooccurrence.embeddings(cooccurrence.pair_counts(decks), 4)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    at = {c: i for i, c in enumerate(names)}
    assert v[at[2]] @ v[at[3]] > v[at[2]] @ v[at[5]]
    assert v.shape == (6, 4)


def test_ppmi_plans_counts_four_times(spark):
    counts = spark.createDataFrame([(1, 2, 4), (1, 3, 1), (2, 3, 1)], "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    got = cooccurrence.ppmi(counts)
    assert {(r.a, r.b): r.ppmi for r in got.collect()} == pytest.approx({(1, 2): np.log(4 * 12 / 25), (1, 3): np.log(12 / 10), (2, 3): np.log(12 / 10)})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [a#") == 4


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [("s", ",".join(map(str, sorted(d))), sorted(map(int, d)), 10) for d in {tuple(sorted(rng.choice(14, 8, replace=False))) for _ in range(60)}]
    df = spark.createDataFrame(rows, "segment string, deck_key string, cards array<int>, plays int")
    got = {(r.deck, r.neighbour): r.changes for r in neighbours.near_decks(df, 2).collect()}
    want = {(a[1], b[1]): 8 - len(set(a[2]) & set(b[2])) for a in rows for b in rows if a[1] != b[1] and 8 - len(set(a[2]) & set(b[2])) <= 2}
    assert got == want


def some_decks(spark, seed=5):
    """Decks of 0 to 5 of 9 cards in two segments, as rows and as a table."""
    rng = np.random.default_rng(seed)
    decks = {(s, tuple(sorted(map(int, rng.choice(9, size, replace=False))))) for s in ("s", "t") for size in rng.integers(0, 6, 60)}
    rows = [(s, ",".join(map(str, d)), list(d), int(rng.integers(1, 6))) for s, d in sorted(decks)]
    return rows, spark.createDataFrame(rows, "segment string, deck_key string, cards array<int>, plays long")


def pairs_within(rows, changes):
    """All pairs by brute force: (segment, deck, neighbour) and by how many cards they differ."""
    apart = lambda a, b: max(len(a[2]), len(b[2])) - len(set(a[2]) & set(b[2]))
    return {(a[0], a[1], b[1]): apart(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and apart(a, b) <= changes}


def many_small(spark, n=600):
    """Pairs of neighbouring cards: all within two changes of each other, few within one."""
    return spark.range(n).select(F.lit("s").alias("segment"), F.concat_ws(",", "id", F.col("id") + 1).alias("deck_key"), F.array("id", F.col("id") + 1).alias("cards"), (F.col("id") % 7).alias("plays"))


def most_rows(df):
    """The rows of the operator that made most of them."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        own = node.metrics().get("numOutputRows")
        below = [node.children().apply(i) for i in range(node.children().size())] + ([node.plan()] if kind.endswith("QueryStageExec") else [])
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("changes", [1, 2, 5])
def test_most_played_near_against_all_pairs(spark, changes):
    rows, df = some_decks(spark)
    plays = {(s, k): p for s, k, _, p in rows}
    want = {}
    for (s, deck, other), apart in sorted(pairs_within(rows, changes).items(), key=lambda x: (-plays[x[0][0], x[0][2]], x[0][2])):
        want.setdefault((s, deck), []).append((other, apart))
    got = {}
    for r in sorted(neighbours.most_played_near(df, changes, 3).collect(), key=lambda r: r.place):
        got.setdefault((r.segment, r.deck), []).append((r.neighbour, r.changes))
    assert got == {k: v[:3] for k, v in want.items()}


def test_most_played_near_makes_few_pairs(spark):
    assert most_rows(neighbours.most_played_near(many_small(spark), 2, 3)) < 600 * 10


@pytest.mark.parametrize("changes", [1, 2, 5])
def test_feasibility_against_all_pairs(spark, changes):
    rows, df = some_decks(spark)
    well = {(s, k) for s, k, _, p in rows if p >= 3}
    near = pairs_within(rows, changes)
    for r in neighbours.feasibility(df, changes, 3).collect():
        n = [sum(1 for (s, deck, other), apart in near.items() if (s, deck) == (r.segment, k) and apart <= r.changes and (s, other) in well) for s, k, _, _ in rows if s == r.segment]
        assert r.seeds == len(n) and (r.median, r.p10, r.p90) == pytest.approx(tuple(np.quantile(n, [0.5, 0.1, 0.9]))) and r.share_none == pytest.approx(n.count(0) / len(n))


def test_feasibility_makes_few_pairs(spark):
    assert most_rows(neighbours.feasibility(many_small(spark), 2, 3)) < 600 * 10


@pytest.mark.parametrize("changes", [1, 2, 5])
def test_pools_against_all_pairs(spark, changes):
    rows, df = some_decks(spark)
    seeds = {(s, k) for s, k, _, p in rows if p >= 4}
    want = [(s, deck, other) for s, deck, other in pairs_within(rows, changes) if (s, deck) in seeds] + [(s, k, k) for s, k in seeds]
    assert sorted(tuple(r) for r in neighbours.pools(df, df.where("plays >= 4"), changes).collect()) == sorted(want)


def test_pools_make_few_other_pairs(spark):
    df = many_small(spark)
    seeds = df.where("deck_key in ('3,4', '10,11')")
    got = neighbours.pools(df, seeds, 2)
    assert got.count() == 2 * 600 and most_rows(got) < 600 * 10


@pytest.mark.parametrize("changes", [1, 2, 5])
def test_near_decks_of_few_cards_in_blocks(spark, changes, monkeypatch):
    """Decks without cards have neighbours too, and blocks of small decks leave out no pair."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rows, df = some_decks(spark)
    got = neighbours.near_decks(df, changes).collect()
    assert len(got) == len({(r.segment, r.deck, r.neighbour) for r in got})
    assert {(r.segment, r.deck, r.neighbour): r.changes for r in got} == pairs_within(rows, changes)


def test_selection_curse_is_the_mean_over_subsets(spark):
    from itertools import combinations

    score, truth = [0.9, 0.8, 0.7, 0.4, 0.1], [0.5, 0.6, 0.4, 0.5, 0.3]
    df = spark.createDataFrame([("s", str(i), a, b) for i, (a, b) in enumerate(zip(score, truth))], "segment string, deck_key string, score double, truth double")
    for r in neighbours.selection_curse(df, (1, 2, 3, 5, 9)).collect():
        best = [min(c) for c in combinations(range(5), r.size)]
        assert r.promised == pytest.approx(np.mean([score[i] for i in best])) and r.observed == pytest.approx(np.mean([truth[i] for i in best])) and r.mass == pytest.approx(1)


def test_admission_falls_back(spark):
    df = spark.createDataFrame([("p", "a", 0.9, 5, 0.4), ("p", "b", 0.8, 50, 0.6)], "pool string, deck_key string, score double, train_n int, quality double")
    got = {r.rule: r for r in neighbours.admission(df, {"free": "true", "30": "train_n >= 30", "999": "train_n >= 999"}, ["pool"]).collect()}
    assert got["30"].delta_vs_unrestricted == pytest.approx(0.2) and got["30"].changed_selection_share == 1
    assert got["999"].empty_pool_share == 1 and got["999"].delta_vs_unrestricted == 0


def test_hero_adjustment(spark):
    schema = "team_card_ids array<int>, opponent_card_ids array<int>, team_evolution_levels array<int>, opponent_evolution_levels array<int>, team_hero_levels array<int>, opponent_hero_levels array<int>"
    terms = {26000014: 0.2, 26000000: -0.1}
    rows = [([26000014, 1], [2, 3], [0, 1], [0, 0], [1, 0], [0, 0]), ([26000014, 1], [2, 3], [0, 0], [1, 0], [1, 0], [0, 0]), ([26000014, 26000000], [26000000, 5], [3, 2], [1, 2], [0, 0], [1, 0])]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(correction.hero_adjustment(terms)).collect()]
    assert got == pytest.approx([0.15, 0.0, 0.75 * ((0.2 - 0.1) + 0.1)])
    assert [r[0] for r in swapped(df).select(correction.hero_adjustment(terms)).collect()] == pytest.approx([-x for x in got])


def test_model_is_antisymmetric(spark):
    rng = np.random.default_rng(5)
    deck = lambda: sorted(map(int, rng.choice(6, 3, replace=False)))
    rows = []
    for i in range(600):
        a, b = deck(), deck()
        rows.append((i, "s", a, b, ",".join(map(str, a)), ",".join(map(str, b)), bool(rng.uniform() < 1 / (1 + math.exp(-(sum(a) - sum(b)) / 3)))))
    df = spark.createDataFrame(rows, "game_id int, segment string, team_card_ids array<int>, opponent_card_ids array<int>, team_deck_key string, opponent_deck_key string, win boolean").cache()
    m = model.train(df, range(6), [(0, 1), (2, 3)], smoothing=0.02)
    out = m.probabilities(df).select("game_id", "probability", "forward", "reverse").toPandas()
    back = m.probabilities(swapped(df)).select("game_id", F.col("probability").alias("q")).toPandas()
    both = out.merge(back, on="game_id")
    assert np.abs(both.probability + both.q - 1).max() < 1e-12 and np.abs(out.forward + out.reverse - 1).max() < 1e-12
    scored = m.probabilities(df).withColumn("target", F.col("win"))
    assert metrics.scalar_metrics(scored).first().auc > 0.7
    m = model.calibrate(m, df, least=100)
    assert m.lines.where("segment is null").count() == 1 and all(0.05 <= r.temperature <= 10 and -5 <= r.bias <= 5 for r in m.lines.collect())
    whole = m.attributions(df, top=9).groupBy("game_id").agg(F.sum("delta").alias("d")).count()
    assert whole <= 600


def test_projection_bounds(spark):
    df = spark.createDataFrame([(0.7, 0.2), (1.0, 0.0), (0.0, 1.0)], "p double, r double")
    for r in df.select(correction.projected(F.col("p"), F.col("r")).alias("a"), correction.projected(F.col("r"), F.col("p")).alias("b")).collect():
        assert r.a + r.b == pytest.approx(1) and 0 <= r.a <= 1


def test_prior(spark):
    cs = lambda c: F.concat(F.lit("a"), F.array_min(c).cast("string"))
    rows = [(1, "s", [1, 2], [3, 4], True), (2, "s", [1, 5], [3, 6], True), (3, "s", [3, 6], [1, 2], False), (4, "s", [7], [8], True)]
    df = spark.createDataFrame(rows, "game_id int, segment string, team_card_ids array<int>, opponent_card_ids array<int>, win boolean")
    keyed = prior.keys(df, cs, cs, cs, F.col("segment"))
    m = prior.matrix(keyed.where("game_id < 4"), prior.keys(swapped(df.where("game_id < 4")), cs, cs, cs, F.col("segment")))
    got = {r.game_id: r for r in prior.attach(keyed, m).collect()}
    assert got[1].matrix_prior > 0.5 > got[3].matrix_prior and got[1].matrix_prior + got[3].matrix_prior == pytest.approx(1)
    assert got[4].matrix_prior == 0.5 and not got[4].covered_archGlobal
    bounds = spark.createDataFrame([(100.0,), (-100.0,), (float("nan"),), (None,)], "p double").select(prior.clamped(F.col("p")))
    assert [r[0] for r in bounds.collect()] == [0.999, 0.001, 0.5, 0.5]
    given = prior.provided(df, lambda b: b["game_id"] * 0.3)
    assert [round(r.matrix_prior, 3) for r in given.orderBy("game_id").collect()] == [0.3, 0.6, 0.9, 0.999]


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(20, 5)), rng.normal(size=(60, 5))
    frame = lambda x, at: spark.createDataFrame([(at + i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")
    got = {r.id: r.distance for r in composition.nearest(frame(a, 0), frame(b, 1000), 7, block=16).collect()}
    d = np.sort(np.linalg.norm(a[:, None] - b[None], axis=2), axis=1)[:, :7].mean(axis=1)
    assert [got[i] for i in range(20)] == pytest.approx(d.tolist())


def test_beam(spark):
    score = lambda d: d.withColumn("score", F.aggregate("cards", F.lit(0), lambda t, c: t + c))
    start = spark.createDataFrame([([0, 1, 2],)], "cards array<int>")
    best = search.beam(start, spark.createDataFrame([(i,) for i in range(9)], "card int"), score, 5, 4, ~F.array_contains("cards", 8)).orderBy(F.desc("score")).first()
    assert best.cards == [5, 6, 7]


def test_sides_and_swap(spark):
    df = spark.createDataFrame([(1, None, "s", "p", [1], [2], "1", "2", True, 0.62)], "game_id int, battle_time timestamp, segment string, patch string, team_card_ids array<int>, opponent_card_ids array<int>, team_deck_key string, opponent_deck_key string, win boolean, matrix_prior float")
    assert {(r.deck_key, r.won) for r in sides(df).collect()} == {("1", True), ("2", False)}
    back = swapped(df).first()
    assert (back.team_deck_key, back.win, round(back.matrix_prior, 6)) == ("2", False, 0.38)
    assert swapped(swapped(df)).first().team_card_ids == [1]


def test_ranks_and_percentiles_of_crowded_columns(spark):
    """One value in most rows, nulls and ties: ranks are whole, no cell holds much, percentiles are numpy's."""
    rng = np.random.default_rng(11)
    values = [0.5] * 3000 + rng.uniform(size=900).tolist() + [None] * 100
    df = spark.createDataFrame([(i, v, f"g{i % 3}") for i, v in enumerate(values)], "id int, v double, g string").repartition(7)
    got = sorted((r["rank"], (r.v is not None, r.v or 0.0), r.id, r.n) for r in metrics.ranked(df, ["v", "id"]).collect())
    assert [g[0] for g in got] == list(range(1, 4001)) and [g[1:3] for g in got] == sorted(g[1:3] for g in got) and got[0][3] == 4000
    cells = metrics.running(df.withColumn("w", F.lit(1)), ["v", "id"], "w", "before").select("before").distinct().count()
    assert cells == 4000
    of = {r.g: r for r in metrics.exact_percentiles(df, F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.9}, ["g"]).collect()}
    for g in range(3):
        own = [v for i, v in enumerate(values) if i % 3 == g and v is not None]
        assert [of[f"g{g}"][n] for n in "abc"] == pytest.approx(list(np.quantile(own, [0.1, 0.5, 0.9])))
    none = metrics.exact_percentiles(df.where("false"), F.col("v"), {"a": 0.5}).collect()
    assert [r.a for r in none] == [None]


def test_most_played_neighbours(spark):
    near = spark.createDataFrame([("s", "a", "b", 1), ("s", "a", "c", 1), ("s", "a", "d", 2), ("s", "b", "a", 1)], "segment string, deck string, neighbour string, changes int")
    decks = spark.createDataFrame([("s", "a", 9), ("s", "b", 5), ("s", "c", 7), ("s", "d", 5)], "segment string, deck_key string, plays int")
    got = neighbours.most_played(near, decks, 2).collect()
    assert sorted((r.deck, r.neighbour, r.place) for r in got) == [("a", "b", 2), ("a", "c", 1), ("b", "a", 1)]


def test_admission_intervals(spark):
    rows = [(f"s{i}", f"d{j}", 0.1 * j, 10 * (4 - j), 0.3 + (0.05 * i if j == 1 else 0.0)) for i in range(8) for j in range(3)]
    df = spark.createDataFrame(rows, "segment string, deck_key string, score double, train_n int, quality double")
    got = {r.rule: r for r in neighbours.admission_intervals(df, {"all": "true", "many": "train_n >= 30", "none": "false"}, ["segment"], 100).collect()}
    assert got["all"].low == got["all"].high == got["none"].delta == 0.0 and got["many"].samples == 100
    assert abs(got["many"].delta - 0.05 * 3.5) < 1e-9 and 0 < got["many"].low < got["many"].delta < got["many"].high < 0.35


def test_changes_and_largest(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, -5.0), ("b", 1, 3.0), ("b", 2, None)], "s string, t int, v double")
    assert {(r.s, r.t): r.change for r in deck_stats.changes(df, "v", "t", ["s"]).collect()} == {("a", 1): None, ("a", 2): -7.0, ("b", 1): None, ("b", 2): None}
    assert [(r.s, r.v) for r in deck_stats.largest(df, "v", 2, "s").collect()] == [("a", -5.0), ("b", 3.0)]


def test_resolve_names(spark):
    catalogue = spark.createDataFrame([(2, "Ice Spirit"), (1, "ice spirit"), (3, "Log")], "card int, name string")
    got = composition.resolve(spark.createDataFrame([(" ICE-Spirit",), ("log ",), ("x",), (None,)], "name string"), catalogue).collect()
    assert {r.name: r.card for r in got} == {" ICE-Spirit": 1, "log ": 3, "x": None, None: None}
