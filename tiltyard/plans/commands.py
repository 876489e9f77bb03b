"""What the command line does: each command reads and writes Parquet and JSON at given paths."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions import cards, payload, segments
from tiltyard.operators import cooccurrence, metrics, prepare, prior, unseen
from tiltyard.plans import model
from tiltyard.sources import files
from tiltyard.sources.battles import matchup_key, swapped
from tiltyard.sources.replay import BattleLog
from tiltyard.streaming import collect

SPLITS = ("train", "validation", "test")


def fs_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_json(spark: SparkSession, path: str, value) -> None:
    text = value if isinstance(value, str) else json.dumps(value, default=str)
    fs, at = fs_path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def report(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def split_of(spark: SparkSession, prepared: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{prepared}/rows").where(F.col("split") == name).drop("split")


def do_prepare(spark: SparkSession, raw: str, out: str, days: float | None = None, edges=segments.LEAGUES) -> None:
    """Raw shards to splits by time, vocabularies, frequencies and a manifest."""
    battles = prepare.first_of(files.battles(spark, raw), ["game_id"], F.col("inserted_at"), F.col("source_fingerprint"))
    battles = battles.withColumn("segment", segments.pooled(F.col("segment"), F.col("mode_key"), edges)).where("battle_time is not null")
    battles.write.mode("overwrite").parquet(f"{out}/_clean")  # once, for the passes that follow
    clean = spark.read.parquet(f"{out}/_clean")
    if days:
        clean = prepare.history(clean, "battle_time", days)
    rows = prepare.split(clean, prepare.cutoffs(clean))
    files.write_splits(rows, f"{out}/rows")
    train = split_of(spark, out, "train")
    names = {"cards": prepare.vocabulary(prepare.cards_of(train), "card", sorted(cards.ELIXIR)), "segments": prepare.vocabulary(train, "segment"), "patches": prepare.vocabulary(train, "patch")}
    for name, v in names.items():
        v.coalesce(1).write.mode("overwrite").parquet(f"{out}/vocabulary/{name}")
    prepare.card_frequencies(train).coalesce(1).write.mode("overwrite").parquet(f"{out}/card_frequencies")
    absent = [r["card"] for r in prepare.unseen_cards(clean, train).collect()]
    fs, at = fs_path(spark, f"{out}/_clean")
    write_json(spark, f"{out}/manifest.json", report(prepare.manifest(spark.read.parquet(f"{out}/rows")))[0] | {"cards_absent_from_train": absent})
    fs.delete(at, True)


def do_pretrain_cards(spark: SparkSession, prepared: str, out: str, size: int = 16) -> None:
    train = split_of(spark, prepared, "train")
    decks = train.select(F.explode(F.array("team_card_ids", "opponent_card_ids")).alias("cards"))
    names, vectors = cooccurrence.embeddings(cooccurrence.pair_counts(decks), size)
    spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(names, vectors)], "card bigint, vector array<double>").coalesce(1).write.mode("overwrite").parquet(out)


def describe(cards_):
    """The archetype of a deck by which priors are kept: its cheapest cost and its mean cost, its size, its spells."""
    costs = F.transform(cards_, cards.elixir)
    mean = F.round(F.aggregate(costs, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(costs), F.lit(1))).cast("int")
    spells = F.size(F.filter(cards_, lambda c: (c >= 28_000_000) & (c < 29_000_000)))
    return {"archetype": F.concat_ws("-", F.array_min(costs).cast("string"), mean.cast("string")), "plan": mean.cast("string"), "spells": spells.cast("string")}


def keyed(battles: DataFrame) -> DataFrame:
    of = lambda n: lambda c: describe(c)[n]
    return prior.keys(battles, of("archetype"), of("plan"), of("spells"), segments.prior_bucket(F.col("segment")))


def do_attach_prior(spark: SparkSession, prepared: str) -> None:
    """Priors learned from training rows alone, written into all splits."""
    train = split_of(spark, prepared, "train")
    matrix = prior.matrix(keyed(train), keyed(swapped(train)))
    matrix.coalesce(1).write.mode("overwrite").parquet(f"{prepared}/prior_matrix")
    rows = spark.read.parquet(f"{prepared}/rows")
    scored = prior.attach(keyed(rows), spark.read.parquet(f"{prepared}/prior_matrix"))
    write_json(spark, f"{prepared}/prior_coverage.json", report(prior.coverage(scored))[0])
    out = scored.select([F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    files.write_splits(out, f"{prepared}/rows_new")
    for old, new in ((f"{prepared}/rows", f"{prepared}/rows_old"), (f"{prepared}/rows_new", f"{prepared}/rows")):
        fs, at = fs_path(spark, old)
        if not fs.rename(at, fs_path(spark, new)[1]):
            raise OSError(f"{old} can't be moved")
    fs, at = fs_path(spark, f"{prepared}/rows_old")
    fs.delete(at, True)


def do_train(spark: SparkSession, prepared: str, out: str, pairs: int = 64, least: int = 2000) -> None:
    """The model over the cards and the pairs most often met, its calibration on validation."""
    train = split_of(spark, prepared, "train")
    known = [r["card"] for r in prepare.card_frequencies(train).orderBy(F.desc("n"), "card").limit(256).collect()]
    met = cooccurrence.pair_counts(train.select(F.concat("team_card_ids", "opponent_card_ids").alias("cards")))
    often = [(r["a"], r["b"]) for r in met.orderBy(F.desc("n"), "a", "b").limit(pairs).collect()]
    m = model.train(train, known, often, prior="matrix_prior")
    m = model.calibrate(m, split_of(spark, prepared, "validation"), least, bias=False)
    write_json(spark, out, m.to_json())


def load(spark: SparkSession, path: str) -> model.Model:
    return model.Model.from_json(spark, read_text(spark, path))


def predicted(spark: SparkSession, path: str, battles: DataFrame) -> DataFrame:
    return load(spark, path).probabilities(battles).withColumn("target", F.col("win"))


def do_evaluate(spark: SparkSession, prepared: str, model_path: str, out: str) -> None:
    p = predicted(spark, model_path, split_of(spark, prepared, "test")).cache()
    slope, intercept = metrics.calibration_line(p)
    write_json(spark, out, {
        "overall": report(metrics.scalar_metrics(p))[0] | {"slope": slope, "intercept": intercept}, "by_segment": report(metrics.scalar_metrics(p, ["segment"])),
        "fixed": report(metrics.fixed_calibration(p)), "quantile": report(metrics.quantile_calibration(p, "game_id")), "intervals": report(metrics.bootstrap(p, "game_id")),
    })
    p.unpersist()


def do_evaluate_unseen(spark: SparkSession, prepared: str, model_path: str, out: str) -> dict:
    """Levels of new matchups with metrics, and whether those of unseen ones reach AUC 0.55 and Brier 0.25."""
    marked = unseen.mark_unseen(split_of(spark, prepared, "train"), split_of(spark, prepared, "test"))
    p = predicted(spark, model_path, marked).cache()
    found = {"levels": report(unseen.levels(p)), "split": report(unseen.strict_split(p))[0], "metrics": {n: report(metrics.scalar_metrics(unseen.level_rows(p, n)))[0] for n in unseen.LEVELS}}
    whole = found["metrics"]["all_unseen_matchups"]
    found["passes"] = bool(whole["rows"] and (whole["auc"] or 0) > 0.55 and whole["brier_score"] < 0.25)
    write_json(spark, out, found)
    p.unpersist()
    return found


def do_evaluate_meta(spark: SparkSession, prepared: str, model_path: str, out: str, least: int = 20) -> None:
    p = predicted(spark, model_path, split_of(spark, prepared, "test"))
    write_json(spark, out, report(metrics.meta_report(p, least))[0] | {"predicted_meta_distribution": report(metrics.class_distribution(p))})


def do_benchmark(spark: SparkSession, prepared: str, model_path: str, out: str, least: int = 20) -> None:
    p = predicted(spark, model_path, split_of(spark, prepared, "test"))
    p = p.withColumns({"matchup_key": matchup_key(F.col("team_deck_key"), F.col("opponent_deck_key")), "matrix_prior": F.col("matrix_prior").cast("double"), "constant": F.lit(0.5)})
    write_json(spark, out, {"models": report(metrics.benchmark(p, "matchup_key", ("matrix_prior", "probability", "constant"), least)), "noise_floor": report(metrics.noise_floor(p, "matchup_key", least))[0]})


def do_predict(spark: SparkSession, model_path: str, rows: str, out: str) -> None:
    """A prediction record for each battle of a Parquet path."""
    load(spark, model_path).records(files.battles(spark, rows)).write.mode("overwrite").parquet(out)


def do_diagnose(spark: SparkSession, raw: str, out: str) -> None:
    write_json(spark, out, report(prepare.segment_diagnostics(files.battles(spark, raw, ["segment"]))))


def do_backfill(spark: SparkSession, raw: str, leagues: str, out: str) -> None:
    """Ranked rows without a league get it from (fingerprint, league); labels that are there stay."""
    found = spark.read.parquet(leagues).select(F.col("fingerprint").alias("_f"), F.col("league").alias("_l"))
    rows = files.battles(spark, raw)
    rows.join(found, F.col("source_fingerprint") == F.col("_f"), "left").withColumn("segment", segments.backfilled(F.col("segment"), F.col("mode_key"), F.col("_l"))).drop("_f", "_l").write.mode("overwrite").parquet(out)


def eligible(log: DataFrame, least: int, since: str | None) -> DataFrame:
    """Battles of a log as fact rows: parsed, fresh, and of segments worth keeping."""
    b = F.from_json("battle", "type STRING, gameMode STRUCT<name: STRING>")
    rows = log.select(F.col("battle").alias("raw"), payload.fingerprint(F.col("tag"), F.from_json("battle", payload.PAYLOAD)).alias("fingerprint"), segments.mode_of(b["type"], b["gameMode"]["name"]).alias("mode_key"), F.current_timestamp().alias("inserted_at"))
    out = payload.parse_battles(rows).where(segments.tracked(F.col("segment"), least))
    return collect.fresh(out, "battle_time", F.lit(since).cast("timestamp")) if since else out


def do_collect(spark: SparkSession, log: str, out: str, checkpoint: str, least: int = 5000, since: str | None = None) -> None:
    """Recorded battle logs as a stream: each battle once, into shards; run again, it goes on."""
    spark.dataSource.register(BattleLog)
    stream = spark.readStream.format("battlelog").option("path", log).load()
    collect.drain(collect.deduplicated(eligible(stream, least, since), "battle_time", ["game_id"], "30 days"), out, checkpoint)


def do_extract(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int, int], out: str, **options: str) -> None:
    """A table of raw battles (raw, fingerprint, mode_key, battle_time, inserted_at), in parallel ranges, to new shards."""
    rows = files.read_table(spark, url, table, key, bounds, **options)
    parsed = prepare.first_of(payload.parse_battles(rows), ["game_id"], F.col("inserted_at"), F.col("source_fingerprint"))
    fs, at = fs_path(spark, out)
    if fs.exists(at):
        parsed = parsed.join(files.battles(spark, out, ["game_id"]).withColumnRenamed("game_id", "_seen"), F.col("game_id") == F.col("_seen"), "left_anti")
    files.write_shards(parsed, out)


def do_drain(spark: SparkSession, source: str, out: str, checkpoint: str, delete=None) -> None:
    """Raw rows of a folder archived as shards, and then handed to ``delete``, batch by batch in that order."""
    kind = "raw string, fingerprint string, mode_key string, battle_time timestamp, inserted_at timestamp, league_number int"

    def write(batch: DataFrame, number: int) -> None:
        prepare.first_of(payload.parse_battles(batch), ["game_id"], F.col("inserted_at"), F.col("source_fingerprint")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def seen(batch: DataFrame, number: int) -> None:
        batch.select("fingerprint").write.mode("overwrite").parquet(f"{checkpoint}-seen/batch={number}")

    collect.archive(collect.read(spark, source, kind), checkpoint, write, seen, delete or (lambda batch, number: None))


def do_copy(spark: SparkSession, source: str, target: str) -> int:
    """Files that the target lacks, from any file system to any other; how many were copied."""
    fs, at = fs_path(spark, source)
    to_fs, to = fs_path(spark, target)
    to_fs.mkdirs(to)
    done = 0
    for status in fs.listStatus(at):
        if status.isFile() and not to_fs.exists(path := spark._jvm.org.apache.hadoop.fs.Path(to, status.getPath().getName())):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, status.getPath(), to_fs, path, False, spark._jsc.hadoopConfiguration())
            done += 1
    return done


def do_attach_terms(spark: SparkSession, model_path: str, out: str, sha256: str | None = None, shrinkage: float = 0.75) -> None:
    """The hero terms put into a model, which must be the one they were measured for if its digest is given."""
    text = read_text(spark, model_path)
    if sha256 and hashlib.sha256(text.encode()).hexdigest() != sha256:
        raise ValueError("the model isn't the one that the terms were measured for")
    m = model.Model.from_json(spark, text)
    m.coefficients, m.shrinkage = dict(cards.HERO_TERMS), shrinkage
    write_json(spark, out, m.to_json())


