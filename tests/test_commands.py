import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_functions import battle
from tiltyard import cli
from tiltyard.operators import composition, discriminator
from tiltyard.plans import encode
from tiltyard.sources import files
from tiltyard.sources.battles import swapped


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Two thousand battles through the battle log's JSON, some twice; low cards win."""
    folder = tmp_path_factory.mktemp("log")
    rng = np.random.default_rng(4)
    for player in range(20):
        games = []
        for i in range(100):
            a, b = (sorted(map(int, rng.choice(14, 8, replace=False))) for _ in range(2))
            win = rng.uniform() < 1 / (1 + np.exp((sum(a) - sum(b)) / 6))
            card = lambda c: {"id": 26000000 + c, "level": 11}
            games.append(battle([card(c) for c in a], [card(c) for c in b], (3, 1) if win else (0, 2), type="PvP", battleTime=f"202606{player + 1:02d}T{i // 10:02d}{i % 60:02d}00.000Z"))
        (folder / f"P{player:02d}.json").write_text(json.dumps(games + games[:3]))
    return folder


def run(spark, *args):
    cli.main([str(a) for a in args], spark)


def test_from_log_to_reports(spark, raw, tmp_path):
    at = lambda name: str(tmp_path / name)
    run(spark, "collect-api", raw, at("raw"), at("mark"))
    run(spark, "collect-api", raw, at("raw"), at("mark"))
    got = files.battles(spark, at("raw"))
    n = got.count()
    assert n == got.select("game_id").distinct().count() and 1900 <= n <= 2000
    run(spark, "diagnose-ranked-segments", at("raw"), at("diagnosis.json"))
    run(spark, "prepare", at("raw"), at("prepared"), "--days", "60")
    manifest = json.loads((tmp_path / "prepared/manifest.json").read_text())
    assert manifest["train_rows"] + manifest["validation_rows"] + manifest["test_rows"] == n and manifest["card_vocabulary"] == 15
    run(spark, "pretrain-cards", at("prepared"), at("vectors"), "--size", "4")
    assert spark.read.parquet(at("vectors")).count() == 14
    run(spark, "attach-prior", at("prepared"))
    rows = spark.read.parquet(at("prepared/rows"))
    assert rows.count() == n and rows.select("matrix_prior").distinct().count() > 1
    run(spark, "train", at("prepared"), at("model.json"), "--pairs", "5", "--least", "100")
    run(spark, "evaluate", at("prepared"), at("model.json"), at("evaluation.json"))
    found = json.loads((tmp_path / "evaluation.json").read_text())
    assert found["overall"]["auc"] > 0.7 and sum(b["count"] for b in found["quantile"]) == found["overall"]["rows"]
    run(spark, "evaluate-unseen", at("prepared"), at("model.json"), at("unseen.json"))
    assert json.loads((tmp_path / "unseen.json").read_text())["passes"]
    run(spark, "evaluate-meta", at("prepared"), at("model.json"), at("meta.json"), "--least", "1")
    run(spark, "benchmark", at("prepared"), at("model.json"), at("benchmark.json"), "--least", "1")
    models = {m["model"]: m for m in json.loads((tmp_path / "benchmark.json").read_text())["models"]}
    assert models["probability"]["brier_score"] < models["constant"]["brier_score"]
    run(spark, "attach-hero-evo-correction", at("model.json"), at("corrected.json"))
    with pytest.raises(ValueError):
        run(spark, "attach-hero-evo-correction", at("model.json"), at("x.json"), "--sha256", "0")
    run(spark, "predict", at("corrected.json"), at("raw"), at("records"))
    records = spark.read.parquet(at("records"))
    assert records.count() == n and len(records.columns) == 18
    assert records.where(F.abs(F.col("team_win_probability") + F.col("opponent_win_probability") - 1) > 1e-12).count() == 0
    run(spark, "upload-storage", at("raw"), at("copy"))
    assert files.battles(spark, at("copy")).count() == n


def test_drain_and_backfill(spark, tmp_path):
    rows = [(json.dumps(battle(battleTime=f"2026060{i}T120000.000Z")), f"f{i}", "ranked", None, None, None) for i in range(1, 5)]
    spark.createDataFrame(rows, "raw string, fingerprint string, mode_key string, battle_time timestamp, inserted_at timestamp, league_number int").write.parquet(str(tmp_path / "in"))
    run(spark, "drain-db", tmp_path / "in", tmp_path / "out", tmp_path / "mark")
    run(spark, "drain-db", tmp_path / "in", tmp_path / "out", tmp_path / "mark")
    got = files.battles(spark, str(tmp_path / "out"))
    assert sorted(r.source_fingerprint for r in got.collect()) == ["f1", "f2", "f3", "f4"]
    spark.createDataFrame([("f1", 3), ("f2", 0)], "fingerprint string, league int").write.parquet(str(tmp_path / "leagues"))
    run(spark, "backfill-ranked-segments", tmp_path / "out", tmp_path / "leagues", tmp_path / "filled")
    assert {r.source_fingerprint: r.segment for r in spark.read.parquet(str(tmp_path / "filled")).collect()} == {"f1": "ranked:league-3", "f2": "ranked:unknown", "f3": "ranked:unknown", "f4": "ranked:unknown"}


def test_encoding(spark):
    schema = ", ".join(f"{s}_{n} {k}" for s in ("team", "opponent") for n, k in (("card_ids", "array<bigint>"), ("evolution_levels", "array<int>"), ("hero_levels", "array<int>"), ("card_roles", "array<int>"), ("tower_troop_id", "bigint"))) + ", game_id string, segment string, patch string, matrix_prior float, win boolean"
    row = ([26000000, 26000001], [3, 0], [0, 0], [1, 1], 159000000, [26000002, 99], [0, 0], [0, 0], [1, 1], 159000001, "g", "s", "2026-06", 0.62, True)
    df = spark.createDataFrame([row], schema)
    v = encode.Vocabularies.of(df)
    assert v.cards == {99: 1, 26000000: 2, 26000001: 3, 26000002: 4}
    r = encode.encode(df, encode.Vocabularies({26000000: 1, 26000002: 2}, {159000000: 1}, {"s": 1}, {})).first()
    assert r.team_cards == [1, 0, 0, 0, 0, 0, 0, 0] and r.team_evolution[:2] == [1, 0] and r.team_hero[:2] == [1, 0] and r.team_role[:2] == [3, 1]
    assert r.opponent_cards[:2] == [2, 0] and r.team_elixir[:2] == [3, 3] and r.opponent_elixir[1] == 0 and (r.team_tower, r.opponent_tower, r.segment, r.patch) == (1, 0, 1, 0)
    both = {x.swapped: x for x in encode.both_directions(df, v).collect()}
    again = encode.encode(swapped(df), v).first()
    assert both[True].team_cards == again.team_cards == both[False].opponent_cards and both[True].target == 0


def test_discriminator(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = (np.arange(400) < 100).astype(int)
    x[y == 1, 0] += 1.5
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(400)], "id int, emitted int, a double, b double, `c:d` double")
    columns = ["a", "b", "c:d"]
    assert discriminator.oof_auc(discriminator.out_of_fold(df, columns, "emitted", "id")) > 0.8
    assert {r.config for r in discriminator.sweep(df, columns, "emitted", "id", (0.05, 1.0)).collect() if r.auc > 0.8} == {"0.05", "1.0"}
    weights, intercept = discriminator.fit(df, columns, "emitted", 0.5)
    z = (x - x[y == 0].mean(axis=0)) / x[y == 0].std(axis=0)  # at the optimum the penalised, balanced loss has no slope
    beta = np.array([weights[c] for c in columns]) * x[y == 0].std(axis=0)
    s = x @ np.array([weights[c] for c in columns]) + intercept
    off = np.where(y == 1, 400 / 200, 400 / 600) * (1 / (1 + np.exp(-s)) - y)
    assert np.abs(z.T @ off + beta / 0.5).max() < 1e-6 and abs(off.sum()) < 1e-6
    at = discriminator.operating_point(df, discriminator.linear(weights, intercept), "emitted", 0.05).first()
    assert at.flag_rate_real == pytest.approx(0.05, abs=0.01) and at.flag_rate_emitted > 0.2
    control = {r.config: r.auc for r in discriminator.controls(df, columns, "emitted", "id", {"open": ("true", ()), "without a": ("true", ("a",)), "near": ("a > 0", ())}).collect()}
    assert control["open"] > 0.8 > control["near"] and control["without a"] < 0.65
    scaled = composition.standardised(df, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("b")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)


def test_signals_and_split_selection(spark):
    rng = np.random.default_rng(7)
    f, s = rng.uniform(size=500), rng.uniform(0.4, 0.6, 500)
    truth = s + 0.2 * f - 0.05
    df = spark.createDataFrame([(f"s{i % 3}", f"k{i}", float(s[i]), float(truth[i] + 0.01 * rng.normal()), float(truth[i] + 0.01 * rng.normal()), float(f[i])) for i in range(500)], "segment string, key string, score double, rate double, test double, share double")
    r = discriminator.signals(df, ["share"], "score", "rate", "test", ["segment", "key"], 100).first()
    assert r.c_share == pytest.approx(0.2, abs=0.02) and r.adjusted_mae < r.raw_mae and r.recommended and r.clusters == 500
    members = spark.createDataFrame([("p", f"d{i}", m, float(0.5 + 0.05 * rng.normal())) for i in range(200) for m in range(2)], "pool string, deck string, member int, score double")
    for r in discriminator.split_selection(members, "pool", "deck", "member", "score").collect():
        assert r.promised > 0.6 > r.observed
