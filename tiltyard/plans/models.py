"""Registered queries of parsing, the model, searches and streams."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions import cards, labels, payload
from tiltyard.operators import composition, correction, deck_stats, discriminator, metrics, neighbours, prepare
from tiltyard.plans import encode, model, reports, search
from tiltyard.plans.reports import DECKS_SQL, SEG_DECKS_SQL, catalogue_of, segment_decks
from tiltyard.plans.tables import BANDS, BASE, SPLIT_SQL, rounded, split_battles
from tiltyard.sources import files
from tiltyard.sources.battles import card_universe, derived_battles, sides, swapped
from tiltyard.streaming import collect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Parsing ---------------------------------------------------------------------------------------------


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived battles written as the battle log's JSON."""
    b = derived_battles(spark, sf_dir)
    g = F.col("game_id")
    side = lambda s, crowns: F.struct(
        F.concat(F.lit(f"#{s[0].upper()}"), g.cast("string")).alias("tag"), crowns.alias("crowns"), F.when(g % 3 != 0, (g % 16000).cast("int")).alias("startingTrophies"),
        F.when(g % 7 == 0, (g % 2000).cast("int")).alias("globalRank"), F.transform(f"{s}_card_ids", lambda c: F.struct((F.lit(26000000) + c).cast("bigint").alias("id"), (c % 3 + 9).cast("int").alias("level"), ((g + c) % 4).cast("int").alias("evolutionLevel"))).alias("cards"),
    )
    body = F.struct(
        F.date_format("battle_time", "yyyyMMdd'T'HHmmss.SSS'Z'").alias("battleTime"), F.when(g % 2 == 0, F.lit(None)).otherwise((g % 8).cast("int")).alias("leagueNumber"),
        F.array(side("team", F.when(F.col("win"), 3).otherwise(1))).alias("team"), F.array(side("opponent", F.when(F.col("win"), 1).otherwise(3))).alias("opponent"),
    )
    return b.select(F.to_json(body).alias("raw"), g.cast("string").alias("fingerprint"), F.when(g % 5 < 2, "ranked").when(g % 5 < 4, "ladder").otherwise("party").alias("mode_key"))


TROPHY_CASE = " ".join(f"when game_id % 16000 >= {a} and game_id % 16000 < {b} then 'ladder:{a}-{b - 1}'" for a, b in BANDS)


@register("parse_battles", f"""{BASE} select game_id::varchar fp, battle_time, strftime(battle_time, '%Y-%m') patch, array_to_string(list_transform(team_card_ids, lambda c: 26000000 + c), ',') team_deck_key, win,
    list_transform(team_card_ids, lambda c: cast((game_id + c) % 2 as int)) evo, list_transform(team_card_ids, lambda c: cast(case when ((game_id + c) % 4) & 2 > 0 then 1 else 0 end as int)) hero,
    case when game_id % 5 < 2 then case when game_id % 2 = 0 or game_id % 8 = 0 then 'ranked:unknown' else 'ranked:league-' || (game_id % 8) end
         when game_id % 5 < 4 then case when game_id % 7 = 0 and game_id % 2000 > 0 then case when game_id % 2000 <= 100 then 'ladder:top-100' when game_id % 2000 <= 1000 then 'ladder:top-1000' else 'ladder:top-10000' end
              when game_id % 3 = 0 then 'ladder:unknown' {TROPHY_CASE} else 'ladder:overflow' end else 'party' end segment
    from battles where abs(list_avg(list_transform(team_card_ids, lambda c: c % 3)) - list_avg(list_transform(opponent_card_ids, lambda c: c % 3))) <= 0.75""")
def parse_battles(spark, sf_dir):
    out = payload.parse_battles(payloads(spark, sf_dir), payload.Rules(cards=None, level_gap=0.75))
    out = out.withColumn("battle_time", F.col("battle_time").cast("timestamp_ntz"))
    return out.select(F.col("source_fingerprint").alias("fp"), "battle_time", "patch", "team_deck_key", "win", F.col("team_evolution_levels").cast("array<int>").alias("evo"), F.col("team_hero_levels").cast("array<int>").alias("hero"), "segment")


@register("game_ids", f"""{BASE}, s as (select game_id, strftime(battle_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' t, ['["#T' || game_id || '","' || array_to_string(list_transform(team_card_ids, lambda c: 26000000 + c), ',') || '",' || case when win then 3 else 1 end || ']',
    '["#O' || game_id || '","' || array_to_string(list_transform(opponent_card_ids, lambda c: 26000000 + c), ',') || '",' || case when win then 1 else 3 end || ']'] p from battles) select game_id::varchar fp, sha256('["' || t || '",[' || list_sort(p)[1] || ',' || list_sort(p)[2] || ']]') game_id from s""")
def game_ids(spark, sf_dir):
    return payload.parse_battles(payloads(spark, sf_dir), payload.Rules(cards=None)).select(F.col("source_fingerprint").alias("fp"), "game_id")


ELIXIR_SQL = "values " + ", ".join(f"({k}, {v})" for k, v in sorted(cards.ELIXIR.items()))


@register("deck_elixir", f"{DECKS_SQL}, el as (select col0 card, col1 elixir from ({ELIXIR_SQL}) t(col0, col1)), u as (select deck_key, 26000000 + unnest(cards) % 130 card from decks) select deck_key, cast(sum(coalesce(elixir, 0)) as bigint) elixir, round(avg(elixir), 6) average, count(*) filter (elixir is null) unknown_cards from u left join el using (card) group by 1")
def deck_elixir(spark, sf_dir):
    each = reports.decks_of(spark, sf_dir).select("deck_key", F.explode("cards").alias("c")).withColumn("cost", cards.elixir(F.lit(26000000) + F.col("c") % 130))
    known = F.when(F.col("cost") > 0, F.col("cost"))
    return rounded(each.groupBy("deck_key").agg(F.sum("cost").alias("elixir"), F.avg(known).alias("average"), F.count_if(known.isNull()).alias("unknown_cards")), "average")


# The model -------------------------------------------------------------------------------------------


def fitted(spark: SparkSession, sf_dir: str) -> tuple[model.Model, DataFrame]:
    b = split_battles(spark, sf_dir).cache()
    m = model.train(b.where("split = 'train'"), range(6), list(combinations(range(6), 2)))
    return model.calibrate(m, b.where("split = 'validation'"), least=100, bias=False), b.where("split = 'test'")


@register("model_probabilities")
def model_probabilities(spark, sf_dir):
    m, test = fitted(spark, sf_dir)
    return m.probabilities(test).select("game_id", "segment", "win", "forward", "reverse", "probability", "label", "served_label", "confidence")


@register("model_metrics")
def model_metrics(spark, sf_dir):
    m, test = fitted(spark, sf_dir)
    return metrics.scalar_metrics(m.probabilities(test).withColumn("target", F.col("win")))


@register("model_attributions")
def model_attributions(spark, sf_dir):
    m, test = fitted(spark, sf_dir)
    return m.attributions(test)


@register("segment_calibrations")
def segment_calibrations(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    return m.lines


@register("projection", f"{BASE}, f as (select game_id, round(0.5::double + 0.03::double * (len(team_card_ids) - len(opponent_card_ids)) + 0.01::double * (game_id % 3), 6) p, round(0.5::double - 0.03::double * (len(team_card_ids) - len(opponent_card_ids)), 6) r from battles) select game_id, round(least(greatest(0.5 * (p + 1 - r), 0), 1), 6) probability, round(abs(p + r - 1), 6) error from f")
def projection(spark, sf_dir):
    b, off = derived_battles(spark, sf_dir), F.lit(0.03) * (F.size("team_card_ids") - F.size("opponent_card_ids"))
    f = b.select("game_id", F.round(F.lit(0.5) + off + F.lit(0.01) * (F.col("game_id") % 3), 6).alias("p"), F.round(F.lit(0.5) - off, 6).alias("r"))
    p, r = F.col("p"), F.col("r")
    return rounded(f.select("game_id", correction.projected(p, r).alias("probability"), correction.projection_error(p, r).alias("error")), "probability", "error")


@register("swapped_battles", f"{BASE} select game_id, opponent_deck_key team_deck_key, team_deck_key opponent_deck_key, opponent_card_ids team_card_ids, not win win from battles")
def swapped_battles(spark, sf_dir):
    return swapped(derived_battles(spark, sf_dir)).select("game_id", "team_deck_key", "opponent_deck_key", "team_card_ids", "win")


@register("augmented_battles", f"{BASE}, t as (select *, cast(('0x' || substr(md5('3:' || game_id), 1, 8)) as bigint) % 2 = 1 turned from battles) select game_id, case when turned then opponent_deck_key else team_deck_key end team_deck_key, case when turned then team_deck_key else opponent_deck_key end opponent_deck_key, case when turned then opponent_card_ids else team_card_ids end team_card_ids, win <> turned win from t")
def augmented_battles(spark, sf_dir):
    return model.augmented(derived_battles(spark, sf_dir), 3).select("game_id", "team_deck_key", "opponent_deck_key", "team_card_ids", "win")


@register("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    return model.block_sample(derived_battles(spark, sf_dir), 64, 5).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


# Searches --------------------------------------------------------------------------------------------


@register("deck_changes", f"{SEG_DECKS_SQL}, s as (select distinct cards from sd where len(cards) = 2), e as (select cards, unnest(cards) old from s), n as (select cards, old, p.new from e, (select unnest([1, 2, 6, 8, 9]) as new) p where not list_contains(cards, p.new)) select distinct list_sort(list_append(list_filter(cards, lambda x: x <> old), new)) cards from n")
def deck_changes(spark, sf_dir):
    start = segment_decks(spark, sf_dir).where(F.size("cards") == 2).select("cards").distinct()
    return search.neighbours_of(start, spark.createDataFrame([(c,) for c in (1, 2, 6, 8, 9)], "card int"))


@register("beam_search")
def beam_search(spark, sf_dir):
    """Decks of five cards that beat the most-played ones best, by the cards' own win rates."""
    s = sides(derived_battles(spark, sf_dir, card_universe(spark, sf_dir)))
    rate = s.select("won", F.explode("cards").alias("c")).groupBy("c").agg(F.avg(F.col("won").cast("int")).alias("rate")).cache()

    def score(d: DataFrame) -> DataFrame:
        each = d.select("cards", F.explode("cards").alias("c")).join(rate, "c")
        return each.groupBy("cards").agg(F.round(F.avg("rate"), 9).alias("score"))

    start = s.where(F.size("cards") == 5).select("cards").distinct()
    out = search.beam(start, rate.select(F.col("c").alias("card")), score, 4, 12, F.size(F.array_intersect("cards", F.array(F.lit(0), F.lit(4)))) <= 1)
    rate.unpersist()
    return out


@register("card_numbers")
def card_numbers(spark, sf_dir):
    """The 45 numbers of the catalogue in all forms."""
    rows = catalogue_of(spark, sf_dir).select(
        F.col("card"), F.when(F.col("kind") == "troop", "troop").otherwise(F.col("kind")).alias("type"), F.element_at(F.array(*[F.lit(r) for r in cards.named("tag")[:10]]), (F.col("card") % 10 + 1).cast("int")).alias("role"),
        F.array(F.lit("splash")).alias("flags"), *[(F.col("card") % 6).cast("int").alias(n) for n in ("hitpoints", "damage", "dps", "speed", "range")], F.create_map(F.lit("damage"), F.lit(-1)).alias("nudges"),
        F.when(F.col("card") == 1, F.struct(F.lit(2).alias("cost"), F.array(F.lit("ability_dash")).alias("tags"))).alias("champion_ability"), F.when(F.col("card") == 2, F.struct(F.lit(3).alias("cost"), F.array(F.lit("ability_spawn")).alias("tags"))).alias("hero_ability"),
        F.when(F.col("card") == 3, F.struct(F.lit(2).alias("cycle"), F.array(F.lit("evo_buff")).alias("tags"))).alias("evolution"),
    )
    return cards.numbers(rows)


# Streams ---------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' file as a stream of files: the name is a pattern that only it meets."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return collect.read(spark, f"{sf_dir}/event[s].parquet", kind)


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path, schema = files.work_dir(spark), stream.schema
    collect.drain(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(schema).parquet(f"{path}/out")


@register("stream_dedup", "select user_id, event_type from events group by all")
def stream_dedup(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select("ts", "user_id", "event_type")
    return drained(spark, collect.deduplicated(stream, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@register("stream_fresh", "select event_id from events where ts >= timestamp '2024-01-10'")
def stream_fresh(spark, sf_dir):
    return drained(spark, collect.fresh(event_stream(spark, sf_dir), "ts", F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id"))


@register("stream_segment_counts", "select event_type, count(*) n from events group by 1")
def stream_segment_counts(spark, sf_dir):
    path = files.work_dir(spark)
    counts = collect.running_counts(event_stream(spark, sf_dir), "event_type")
    counts.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/out")


@register("stream_archive", "select event_id, user_id from events")
def stream_archive(spark, sf_dir):
    path = files.work_dir(spark)
    order = []

    def write(batch, number):
        batch.select("event_id", "user_id").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        order.append("write")

    collect.archive(event_stream(spark, sf_dir), f"{path}/checkpoint", write, lambda b, i: order.append("seen"), lambda b, i: order.append("delete"))
    if order != ["write", "seen", "delete"] * (len(order) // 3):
        raise RuntimeError("the archive's steps were out of order")
    return spark.read.schema("event_id bigint, user_id bigint").parquet(f"{path}/out").select("event_id", "user_id")


@register("daily_counts", "select date_trunc('day', ts) as start, event_type, count(*) n from events group by all")
def daily_counts(spark, sf_dir):
    """The windows of the stream, here over the whole table at once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = collect.windowed_counts(events, "ts", "event_type", "1 day", "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("frontier", "with t as (select 'u' || user_id tag, case event_type when 'view' then 'ladder' when 'click' then 'ranked' else 'other' end mode_key, cast(round(value * 100) as int) % 15000 trophies from events), c as (select tag, mode_key, trophies from t where mode_key <> 'ladder' or trophies >= 5000) select tag, min(case when mode_key = 'ladder' then coalesce(case when trophies >= 5000 and trophies < 7000 then 'ladder:5000-6999' when trophies >= 7000 and trophies < 9000 then 'ladder:7000-8999' when trophies >= 9000 and trophies < 12000 then 'ladder:9000-11999' when trophies >= 12000 and trophies < 14000 then 'ladder:12000-13999' when trophies >= 14000 then 'ladder:14000-999998' end, 'ladder:overflow') else mode_key end) band, 1 hop from c where tag not in ('u1', 'u2') group by 1")
def frontier(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mode = F.when(F.col("event_type") == "view", "ladder").when(F.col("event_type") == "click", "ranked").otherwise("other")
    met = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"), mode.alias("mode_key"), (F.round(F.col("value") * 100).cast("int") % 15000).alias("trophies"))
    seeds = spark.createDataFrame([("u1", "ladder:unknown", 0, 1)], collect.FRONTIER)
    seen = spark.createDataFrame([("u2",)], "tag string")
    return collect.extend(seeds, seen, collect.candidates(met, 5000), 1).where("hop = 1").select("tag", "band", "hop")


@register("frontier_quota", "with e as (select event_id::varchar tag, event_type band, 0 hop, cast(('0x' || substr(md5(event_id::varchar), 1, 12)) as bigint) as position from events), q as (select band, greatest(round(100 * count(*)::double / sum(count(*)) over ()), 1) quota from e group by 1), r as (select *, row_number() over (partition by band order by position, tag) n from e) select tag, band, hop, position from r join q using (band) where n <= quota")
def frontier_quota(spark, sf_dir):
    position = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint").alias("position")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("tag"), F.col("event_type").alias("band"), F.lit(0).alias("hop"), position)
    return collect.next_players(e, 100)


@register("incremental_ids", "select event_id from events")
def incremental_ids(spark, sf_dir):
    """Two runs of one drain: the second finds nothing new."""
    path = files.work_dir(spark)
    for _ in range(2):
        collect.drain(event_stream(spark, sf_dir).select("event_id"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("event_id bigint").parquet(f"{path}/out")


# Encoding, discriminators, envelopes, seeds -----------------------------------------------------------

VOCAB_SQL = f"{BASE}, {SPLIT_SQL}, vc as (select card, row_number() over (order by card) i from (select distinct unnest(list_concat(team_card_ids, opponent_card_ids)) card from split where split = 'train')), vp as (select patch, row_number() over (order by patch) i from (select distinct patch from split where split = 'train')), vs as (select segment, row_number() over (order by segment) i from (select distinct segment from split where split = 'train'))"


@register("encoded_rows", f"{VOCAB_SQL}, mp as (select map(list(card order by card), list(i order by card)) m from vc) select game_id, list_concat(list_transform(team_card_ids, lambda c: cast(coalesce(m[c], 0) as int)), [0, 0, 0, 0, 0, 0])[1:6] team_cards, list_concat(list_transform(team_card_ids, lambda c: cast((game_id + c) % 2 as int)), [0, 0, 0, 0, 0, 0])[1:6] team_evolution, list_concat(list_transform(team_card_ids, lambda c: case when (game_id + c) % 4 >= 2 then 3 else 1 end), [0, 0, 0, 0, 0, 0])[1:6] team_role, cast(coalesce(vs.i, 0) as int) segment, cast(coalesce(vp.i, 0) as int) patch from split left join vs using (segment) left join vp using (patch), mp where split = 'test'")
def encoded_rows(spark, sf_dir):
    b = split_battles(spark, sf_dir)
    for side in ("team", "opponent"):
        b = b.withColumns({
            f"{side}_evolution_levels": F.transform(f"{side}_card_ids", lambda c: ((F.col("game_id") + c) % 4).cast("int")), f"{side}_hero_levels": F.transform(f"{side}_card_ids", lambda c: F.lit(0)),
            f"{side}_card_roles": F.transform(f"{side}_card_ids", lambda c: F.lit(1)), f"{side}_tower_troop_id": F.lit(159000000).cast("bigint"),
        })
    b = b.withColumn("matrix_prior", F.lit(0.5)).cache()
    v = encode.Vocabularies.of(b.where("split = 'train'"))
    return encode.encode(b.where("split = 'test'"), v, 6).select("game_id", "team_cards", "team_evolution", "team_role", "segment", "patch")


@register("prediction_records")
def prediction_records(spark, sf_dir):
    m, test = fitted(spark, sf_dir)
    return m.records(test)


PROFILE = ("hits_air", "air_unit", "elixir_mean", "elixir_std", "role:anti-air", "kind:spell")


def two_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of often-played decks (0) and of seldom-played ones (1)."""
    d = reports.decks_of(spark, sf_dir, card_universe(spark, sf_dir))
    f = composition.profile(d, catalogue_of(spark, sf_dir), reports.PROFILE_ROLES, reports.PROFILE_KINDS, ("deck_key", "plays"))
    return f.withColumn("emitted", (F.col("plays") < 8).cast("int"))


@register("deck_discriminator")
def deck_discriminator(spark, sf_dir):
    return discriminator.out_of_fold(two_populations(spark, sf_dir), PROFILE, "emitted", "deck_key")


@register("matched_controls")
def matched_controls(spark, sf_dir):
    few = {"open": ("true", ()), "matched plays": ("plays between 8 and 30", ()), "without elixir": ("true", ("elixir_mean", "elixir_std")), "without roles": ("true", ("role:anti-air",))}
    return discriminator.controls(two_populations(spark, sf_dir), PROFILE, "emitted", "deck_key", few, 3)


@register("operating_point")
def operating_point(spark, sf_dir):
    df = two_populations(spark, sf_dir)
    return discriminator.operating_point(df, discriminator.linear(*discriminator.fit(df, PROFILE, "emitted", 0.25)), "emitted", 0.05)


@register("strength_sweep")
def strength_sweep(spark, sf_dir):
    return discriminator.sweep(two_populations(spark, sf_dir), PROFILE, "emitted", "deck_key", (0.01, 0.1, 1.0, 10.0), 3)


@register("distribution_signals")
def distribution_signals(spark, sf_dir):
    scored = reports.panel_scored(spark, sf_dir).select("segment", "deck_key", "unfavorable_share", "matchup_sigma")
    c = reports.candidates(spark, sf_dir).withColumn("rate", (F.col("score") + 0.5) / 2)
    return discriminator.signals(c.join(scored, ["segment", "deck_key"]), ["unfavorable_share", "matchup_sigma"], "score", "rate", "quality", ["segment", "deck_key"], 200)


ENVELOPE = (0.05, 0.5, 0.95, 0.99)


@register("envelope_body", f"{reports.PANEL_SQL} select segment, count(*) decks, " + ", ".join(f"round(quantile_cont(score, {s}), 6) {deck_stats.name(s)}" for s in ENVELOPE) + ", round(avg(score), 6) mean, round(stddev_pop(score), 6) std, round(max(score), 6) ceiling, round(min(worst_matchup), 6) worst from ps group by 1")
def envelope_body(spark, sf_dir):
    s = reports.panel_scored(spark, sf_dir)
    body = deck_stats.linear_percentiles(s, "score", ENVELOPE, ["segment"])
    ends = s.groupBy(F.col("segment").alias("_s")).agg(F.count(F.lit(1)).alias("decks"), F.max("score").alias("ceiling"), F.min("worst_matchup").alias("worst"))
    out = body.join(ends, F.col("segment") == F.col("_s")).drop("_s")
    return rounded(out, *[deck_stats.name(x) for x in ENVELOPE], "mean", "std", "ceiling", "worst")


@register("ceiling_leaders", f"{reports.PANEL_SQL}, f as (select *, row_number() over (partition by segment order by score desc, deck_key) r from ps) select segment, deck_key, round(score - worst_matchup, 6) score from f where r <= 5")
def ceiling_leaders(spark, sf_dir):
    """Decks that do best on the cheap score, and only they on the full one."""
    s = reports.panel_scored(spark, sf_dir)
    base = s.select("segment", "deck_key", F.col("score").alias("s"), "worst_matchup")
    out = search.leaders(base, lambda d: d.withColumn("score", F.col("s")), lambda d: d.withColumn("score", F.col("s") - F.col("worst_matchup")), "segment", 5)
    return rounded(out.select("segment", "deck_key", "score"), "score")


@register("random_matchups", f"{DECKS_SQL}, nd as (select deck_key, len(cards) n, row_number() over (order by deck_key) - 1 i, count(*) over () c from decks), pr as (select r, cast(('0x' || substr(md5('a' || r), 1, 12)) as bigint) a, cast(('0x' || substr(md5('b' || r), 1, 12)) as bigint) b from range(400) t(r)), m as (select 0.5::double + 0.02::double * (x.n - y.n) p from pr join nd x on x.i = pr.a % x.c join nd y on y.i = pr.b % y.c) select case when p >= 0.55 then 'good' when p <= 0.45 then 'bad' else 'neutral' end label, count(*) n from m group by 1")
def random_matchups(spark, sf_dir):
    """The share of classes over hashed pairs of decks."""
    d = metrics.ranked(reports.decks_of(spark, sf_dir).select(F.lit(0.0).alias("cell_of"), "deck_key", F.size("cards").alias("k")), ["cell_of", "deck_key"]).withColumn("i", F.col("rank") - 1)
    n = d.count()
    draw = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("bigint") % n
    pairs = spark.range(400).select(draw("a").alias("a"), draw("b").alias("b"))
    x, y = (d.select(F.col("i").alias(f"i{s}"), F.col("k").alias(f"k{s}")) for s in "xy")
    met = pairs.join(x, F.col("a") == F.col("ix")).join(y, F.col("b") == F.col("iy"))
    return met.groupBy(labels.served(F.lit(0.5) + F.lit(0.02) * (F.col("kx") - F.col("ky"))).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("balanced_seeds", "select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by md5(c_custkey::varchar), c_custkey) r from customer where c_acctbal >= 0) where r <= 20")
def balanced_seeds(spark, sf_dir):
    """A quota of players of each band, without those that a crawl begins from."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    begun = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("b"))
    return neighbours.strata(c.join(begun, F.col("c_custkey") == F.col("b"), "left_anti"), "c_mktsegment", "c_custkey", 20).select("c_custkey", "c_mktsegment")


@register("ensemble_split_selection", f"{reports.CAND_SQL}, mb as (select segment, deck_key, m.m, score + 0.01::double * ((train_n * (m.m + 3)) % 7) s from ca, (select unnest([0, 1, 2]) m) m), wn as (select * from (select *, row_number() over (partition by segment, m order by s desc, deck_key desc) r from mb) where r = 1), ob as (select w.segment, w.m, w.s promised, avg(o.s) observed from wn w join mb o on o.segment = w.segment and o.deck_key = w.deck_key and o.m <> w.m group by all) select m \"member\", count(*) pools, round(avg(promised), 6) promised, round(avg(observed), 6) observed from ob group by 1")
def ensemble_split_selection(spark, sf_dir):
    c = reports.candidates(spark, sf_dir).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    c = c.withColumn("s", F.col("score") + F.lit(0.01) * ((F.col("train_n") * (F.col("m") + 3)) % 7))
    return rounded(discriminator.split_selection(c, "segment", "deck_key", "m", "s"), "promised", "observed")


@register("even_files", "select 12 files, count(*) n_rows, true even from orders")
def even_files(spark, sf_dir):
    """How many files there are, of how many rows, and whether no two differ by more than the input's partitions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    per = prepare.evened(orders, 12).groupBy(F.spark_partition_id().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    off = F.max("n") - F.min("n") <= orders.rdd.getNumPartitions()
    return per.agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("n").alias("n_rows"), off.alias("even"))
