import json
import os

import pytest
from pyspark.sql import functions as F

from tiltyard.schema import FACT
from tiltyard.sources import files
from tiltyard.sources.replay import BattleLog
from tiltyard.streaming import collect


def test_shards_and_missing_columns(spark, tmp_path):
    old = spark.createDataFrame([("g1", "s")], "game_id string, segment string")
    files.write_shards(old, str(tmp_path / "raw/a"), rows=10)
    got = files.battles(spark, str(tmp_path / "raw"))
    assert got.schema.names == FACT.names
    row = got.first()
    assert row.game_id == "g1" and row.team_global_rank is None
    assert files.battles(spark, str(tmp_path / "raw"), ["segment"]).columns == ["segment"]


def test_max_records(spark, tmp_path):
    files.write_shards(spark.range(100).coalesce(1), str(tmp_path / "x"), rows=30)
    assert len([f for f in os.listdir(tmp_path / "x") if f.endswith(".parquet")]) == 4


def test_replace_reads_and_writes_one_path(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    files.replace(spark.read.parquet(path).where("id < 3"), path)
    assert spark.read.parquet(path).count() == 3
    assert os.listdir(tmp_path) == ["t"]


def test_materialized_by_signature(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.materialized(spark.range(5), path, {"v": 1}).count() == 5
    assert files.materialized(spark.range(9), path, {"v": 1}).count() == 5
    assert files.materialized(spark.range(9), path, {"v": 2}).count() == 9


def test_replace_column(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "game_id string, matrix_prior float, x int")
    out = files.replace_column(df, "matrix_prior", spark.createDataFrame([("a", 0.7)], "game_id string, matrix_prior double"), "game_id")
    assert out.columns == df.columns and {r.game_id: round(r.matrix_prior, 2) for r in out.collect()} == {"a": 0.7, "b": 0.5}


def test_split_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    files.write_splits(df, str(tmp_path / "p"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "p")).where("split = 'test'").collect()] == [2]


def test_catalogue_and_tags(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cards": [{"id": 1, "roles": ["anti-air"], "kind": "troop", "targets": "air", "elixir": 3}, {"name": "no id"}]}))
    (tmp_path / "tags.txt").write_text("#A\n\n  #B \n")
    assert [(r.card, r.roles) for r in files.catalogue(spark, str(tmp_path / "c.json")).collect()] == [(1, ["anti-air"])]
    assert [r.tag for r in files.tags(spark, str(tmp_path / "tags.txt")).collect()] == ["#A", "#B"]
    assert json.loads(files.one_row_json(spark.range(1))) == {"id": 0}


def test_keyset_pages_cover_all(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(20)], "t int, id int")
    seen, at = [], (-1, -1)
    while rows := files.keyset_page(df, ("t", "id"), (F.lit(at[0]), F.lit(at[1])), 7).collect():
        seen += [r.id for r in rows]
        at = tuple(rows[-1])
    assert seen == list(range(20))


def test_battle_log_source(spark, tmp_path):
    (tmp_path / "A.json").write_text(json.dumps([{"type": "PvP"}, {"type": "x"}]))
    (tmp_path / "B.json").write_text("broken")
    spark.dataSource.register(BattleLog)
    got = spark.read.format("battlelog").option("path", str(tmp_path)).load()
    assert sorted((r.tag, json.loads(r.battle)["type"]) for r in got.collect()) == [("#A", "PvP"), ("#A", "x")]


def test_stream_goes_on_and_keeps_first(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "game_id string, battle_time timestamp"
    rows = lambda *ids: spark.createDataFrame([(i, None) for i in ids], schema).withColumn("battle_time", F.lit("2026-06-01 12:00:00").cast("timestamp"))
    rows("a", "a", "b").write.mode("append").parquet(source)
    run = lambda: collect.drain(collect.deduplicated(collect.read(spark, source, schema), "battle_time", ["game_id"], "30 days"), out, mark)
    run()
    rows("b", "c").write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r.game_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_archive_order(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    steps = []
    collect.archive(collect.read(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "mark"), lambda b, i: steps.append("write"), lambda b, i: steps.append("seen"), lambda b, i: steps.append("delete"))
    assert steps == ["write", "seen", "delete"]


def test_frontier(spark):
    met = spark.createDataFrame([("LOW", "ladder", 3000), ("NONE", "ladder", None), ("MID", "ladder", 6000), ("RANK", "ranked", None)], "tag string, mode_key string, trophies int")
    found = collect.candidates(met, 5000)
    assert {r.tag: r.band for r in found.collect()} == {"MID": "ladder:5000-6999", "RANK": "ranked"}
    seeds = spark.createDataFrame([("MID", "x", 0, 1)], collect.FRONTIER)
    front = collect.extend(seeds, spark.createDataFrame([("GONE",)], "tag string"), found, 1)
    assert {(r.tag, r.hop) for r in front.collect()} == {("MID", 0), ("RANK", 1)}
    queue = spark.range(300).select(F.col("id").cast("string").alias("tag"), F.when(F.col("id") < 200, "big").otherwise("small").alias("band"), F.lit(0).alias("hop"), F.xxhash64("id").alias("position"))
    drawn = {r.band: r["count"] for r in collect.next_players(queue, 30).groupBy("band").count().collect()}
    assert drawn == {"big": 20, "small": 10}
    biased = {r.band: r["count"] for r in collect.next_players(queue, 30, spark.createDataFrame([("big", 100), ("small", 0)], "band string, n int"), 1.0).groupBy("band").count().collect()}
    assert biased["small"] > 10


@pytest.mark.parametrize("batches", [1, 3])
def test_running_counts_equal_batch(spark, tmp_path, batches):
    for i in range(batches):
        spark.range(10 * (i + 1)).select((F.col("id") % 3).cast("string").alias("segment")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    collect.running_counts(collect.read(spark, str(tmp_path / "in"), "segment string", 1), "segment").writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "mark")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.segment: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.segment: r["count"] for r in spark.read.parquet(str(tmp_path / "in")).groupBy("segment").count().collect()}
    assert got == want


def test_pull_goes_on_where_it_ended(spark, tmp_path):
    rows = [(1, "b"), (1, "a"), (2, "a"), (3, "c"), (None, "z")]
    df = spark.createDataFrame(rows, "t int, k string")
    path, cursor = str(tmp_path / "pages"), str(tmp_path / "cursor")
    got = lambda: sorted((r.t, r.k) for r in files.pulled(spark, path, df.schema).collect())
    assert files.pull(df, ("t", "k"), path, cursor, 1) == 1 and got() == [(1, "a")]
    assert files.pull(df, ("t", "k"), path, cursor, 2) == 2 and got() == [(1, "a"), (1, "b"), (2, "a")]
    before = spark.read.parquet(cursor).first()
    assert files.pull(df, ("t", "k"), path, cursor) == 1 and files.pull(df, ("t", "k"), path, cursor) == 0
    # a pull whose cursor never moved is done again without rows twice
    files.replace(spark.createDataFrame([before], df.schema), cursor)
    more = df.union(spark.createDataFrame([(4, "a")], df.schema))
    assert files.pull(more, ("t", "k"), path, cursor) == 2 and got() == [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a")]


def test_pull_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "t int, k string")
    assert files.pull(df, ("t", "k"), str(tmp_path / "p"), str(tmp_path / "c")) == 0
    assert not os.path.exists(tmp_path / "c") and files.pulled(spark, str(tmp_path / "p"), df.schema).count() == 0


def test_vectors_of_another_length(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="1 vectors"):
        files.vectors(spark, str(tmp_path / "v"), "v", 2)
