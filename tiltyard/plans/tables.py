"""Registered queries over tables and derived battles: each a Spark plan and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions import decks, labels, segments
from tiltyard.operators import deck_stats, prepare, unseen
from tiltyard.sources import files
from tiltyard.sources.battles import GROWING, PREDICTIONS_SQL, SIDES_SQL, battles_sql, card_universe, derived_battles, matchup_key, predictions, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CUTS = "cuts as (select quantile_cont(epoch(battle_time), [0.7, 0.85]) c from battles)"
CUT_COLUMNS = "c[1] c1, c[2] c2"
BASE = f"with {battles_sql(6)}"
WITH_SIDES = f"{BASE}, {SIDES_SQL}"
PLAYS_SQL = f"{WITH_SIDES}, plays as (select segment, deck_key, count(*) plays, cast(sum(won::int) as bigint) wins from sides group by all)"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def plays_of(spark: SparkSession, sf_dir: str, universe: int = 6) -> DataFrame:
    return deck_stats.play_counts(sides(derived_battles(spark, sf_dir, universe)))


# Scans, projections, filters -------------------------------------------------------------------------


@register("battles_base", f"{BASE} select game_id, battle_time, segment, mode_key, patch, team_deck_key, opponent_deck_key, win from battles")
def battles_base(spark, sf_dir):
    return derived_battles(spark, sf_dir).drop("team_card_ids", "opponent_card_ids")


@register("scan_counts", f"{BASE} select count(*) games, count(distinct team_deck_key) team_decks, cast(sum(win::int) as bigint) wins, max(battle_time) newest from battles")
def scan_counts(spark, sf_dir):
    return derived_battles(spark, sf_dir).agg(F.count(F.lit(1)).alias("games"), F.count_distinct("team_deck_key").alias("team_decks"), F.count_if("win").alias("wins"), F.max("battle_time").alias("newest"))


@register("keyset_page", "select o_orderkey, o_orderdate, o_custkey from orders where (o_orderdate, o_orderkey) > (timestamp '1996-06-01', 100) order by o_orderdate, o_orderkey limit 500")
def keyset_page(spark, sf_dir):
    start = (F.lit("1996-06-01").cast("timestamp_ntz"), F.lit(100).cast("bigint"))
    return files.keyset_page(spark.read.parquet(f"{sf_dir}/orders.parquet"), ("o_orderdate", "o_orderkey"), start, 500).select("o_orderkey", "o_orderdate", "o_custkey")


@register("pulled_pages", "select o_orderkey, o_orderdate, o_custkey from orders")
def pulled_pages(spark, sf_dir):
    """The whole table in pulls that begin where the last one ended: a page, then the rest, then nothing more."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_custkey")
    at = files.work_dir(spark)
    for rows in (500, None, None):
        files.pull(orders, ("o_orderdate", "o_orderkey"), f"{at}/pages", f"{at}/cursor", rows)
    return files.pulled(spark, f"{at}/pages", orders.schema)


@register("vector_lengths", "select vec_id, cast(len(embedding) as int) numbers from embeddings")
def vector_lengths(spark, sf_dir):
    return files.vectors(spark, f"{sf_dir}/embeddings.parquet", "embedding", 64).select("vec_id", F.size("embedding").alias("numbers"))


@register("monthly_changes", f"{WITH_SIDES}, m as (select segment, patch, avg(won::int) rate, count(*) n from sides where side = 'team' group by all) select segment, patch, n, round(rate, 6) rate, round(rate - lag(rate) over (partition by segment order by patch), 6) change from m")
def monthly_changes(spark, sf_dir):
    """A segment's team win rate a month, and what it gained since the month before."""
    m = derived_battles(spark, sf_dir).groupBy("segment", "patch").agg(F.avg(F.col("win").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return rounded(deck_stats.changes(m, "rate", "patch", ["segment"]), "rate", "change")


@register("lookup_scan", "select o_orderkey, o_orderpriority from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 50)")
def lookup_scan(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 50").select("l_orderkey")
    return files.lookup(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", wanted, "l_orderkey").select("o_orderkey", "o_orderpriority")


@register("top_seeds", "select c_custkey, nullif(round(c_acctbal), 0) seen from customer order by seen desc nulls last, c_custkey limit 50")
def top_seeds(spark, sf_dir):
    seen = F.nullif(F.round("c_acctbal"), F.lit(0.0))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", seen.alias("seen")).orderBy(F.desc_nulls_last("seen"), "c_custkey").limit(50)


@register("replace_and_except", "select * exclude (o_custkey) replace (upper(o_orderpriority) as o_orderpriority) from orders where o_orderstatus in ('F', 'P')")
def replace_and_except(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderstatus").isin("F", "P")).withColumn("o_orderpriority", F.upper("o_orderpriority")).drop("o_custkey")


@register("players_join", "select b.l_orderkey, b.l_linenumber, s.s_name, s.s_acctbal from lineitem b left join supplier s on b.l_suppkey = s.s_suppkey and s.s_acctbal > 0")
def players_join(spark, sf_dir):
    rich = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.join(rich, lines["l_suppkey"] == rich["s_suppkey"], "left").select("l_orderkey", "l_linenumber", "s_name", "s_acctbal")


@register("array_predicates", f"{BASE} select game_id, list_has_any(team_card_ids, [1, 3]) has_any, len(list_intersect(team_card_ids, opponent_card_ids)) shared, list_position(team_card_ids, 3) - 1 place from battles")
def array_predicates(spark, sf_dir):
    b = derived_battles(spark, sf_dir)
    at = F.nullif(F.array_position("team_card_ids", 3), F.lit(0).cast("bigint")) - 1
    return b.select("game_id", F.arrays_overlap("team_card_ids", F.array(F.lit(1), F.lit(3))).alias("has_any"), F.size(F.array_intersect("team_card_ids", "opponent_card_ids")).cast("bigint").alias("shared"), at.cast("int").alias("place"))


@register("deck_legality", f"{BASE} select game_id, len(team_card_ids) = 5 and len(list_intersect(team_card_ids, [0, 4])) <= 1 as legal from battles")
def deck_legality(spark, sf_dir):
    return derived_battles(spark, sf_dir).select("game_id", decks.legal(F.col("team_card_ids").cast("array<bigint>"), [0, 4], 5).alias("legal"))


@register("fixed_arrays", f"{BASE} select game_id, list_concat(team_card_ids, [0, 0, 0, 0])[1:4] cards from battles")
def fixed_arrays(spark, sf_dir):
    return derived_battles(spark, sf_dir).select("game_id", decks.fixed(F.col("team_card_ids"), 4).alias("cards"))


@register("player_tags", "select c_custkey, case when ltrim(replace(upper(trim(c_name)), 'O', '0'), '#') = '' then '' else '#' || ltrim(replace(upper(trim(c_name)), 'O', '0'), '#') end tag, replace(lower(trim(c_name)), ' ', '-') slug from customer")
def player_tags(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", decks.tag(F.col("c_name")).alias("tag"), decks.slug(F.col("c_name")).alias("slug"))


@register("json_paths", "select event_id, try_cast(coalesce(json_extract_string(props, '$.league'), json_extract_string(props, '$.k')) as integer) k from events")
def json_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", files.first_path("props", ("$.league", "$.k")).alias("k"))


@register("freshness", "select event_id from events where ts >= (select max(ts) from events) - interval 7 days")
def freshness(spark, sf_dir):
    return prepare.history(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", 7).select("event_id")


# Deduplication, splits, vocabularies ------------------------------------------------------------------


@register("dedup_first", "select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1")
def dedup_first(spark, sf_dir):
    return prepare.first_of(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("event_id", "user_id", "event_type", "value")


@register("dedup_new_batch", "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) r from events where event_type = 'view') where r = 1 and user_id not in (select user_id from events where value > 250)")
def dedup_new_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = events.where("value > 250").select("user_id").distinct()
    return prepare.new_rows(events.where("event_type = 'view'"), seen, "user_id", F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@register("chrono_cutoffs", f"{BASE}, {CUTS} select round(c[1], 6) c1, round(c[2], 6) c2 from cuts")
def chrono_cutoffs(spark, sf_dir):
    return rounded(prepare.cutoffs(derived_battles(spark, sf_dir)), "c1", "c2")


SPLIT_SQL = f"{CUTS}, split as (select b.*, case when epoch(battle_time) <= c[1] then 'train' when epoch(battle_time) <= c[2] then 'validation' else 'test' end split from battles b, cuts)"


def split_battles(spark: SparkSession, sf_dir: str, universe: int | None = 6) -> DataFrame:
    b = derived_battles(spark, sf_dir, universe)
    return prepare.split(b, prepare.cutoffs(b))


@register("chrono_split_counts", f"{BASE}, {SPLIT_SQL} select split, count(*) n, min(battle_time) first_time, max(battle_time) last_time from split group by 1")
def chrono_split_counts(spark, sf_dir):
    return split_battles(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("battle_time").alias("first_time"), F.max("battle_time").alias("last_time"))


@register("history_window", f"{BASE} select segment, count(*) n from battles where battle_time >= (select max(battle_time) from battles) - interval 365 days group by 1")
def history_window(spark, sf_dir):
    return prepare.history(derived_battles(spark, sf_dir), "battle_time", 365).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@register("vocabulary_cards", f"with {battles_sql(None)}, {SPLIT_SQL}, cards as (select unnest(list_concat(team_card_ids, opponent_card_ids)) card from split where split = 'train' union select unnest([0, 3, 42])) select card, row_number() over (order by card) \"index\" from (select distinct card from cards)")
def vocabulary_cards(spark, sf_dir):
    train = split_battles(spark, sf_dir, None).where("split = 'train'")
    return prepare.vocabulary(prepare.cards_of(train), "card", [0, 3, 42]).withColumn("index", F.col("index").cast("bigint"))


for _name in ("segment", "patch"):

    def _vocabulary(spark, sf_dir, name=_name):
        return prepare.vocabulary(split_battles(spark, sf_dir).where("split = 'train'"), name).withColumn("index", F.col("index").cast("bigint"))

    register(f"vocabulary_{_name}s", f"{BASE}, {SPLIT_SQL} select {_name}, row_number() over (order by {_name}) \"index\" from (select distinct {_name} from split where split = 'train')")(_vocabulary)


@register("vocabulary_lookup", f"{BASE}, {SPLIT_SQL}, v as (select patch, row_number() over (order by patch) i from (select distinct patch from split where split = 'train')) select game_id, coalesce(i, 0) patch_index from split left join v using (patch)")
def vocabulary_lookup(spark, sf_dir):
    b = split_battles(spark, sf_dir).cache()
    known = prepare.vocabulary(b.where("split = 'train'"), "patch")
    return b.join(F.broadcast(known), "patch", "left").select("game_id", F.coalesce(F.col("index"), F.lit(0)).cast("bigint").alias("patch_index"))


@register("card_frequencies", f"{BASE} select card, count(*) n from (select unnest(list_concat(team_card_ids, opponent_card_ids)) card from battles) group by 1")
def card_frequencies(spark, sf_dir):
    return prepare.card_frequencies(derived_battles(spark, sf_dir))


@register("cards_absent_from_train", f"with {battles_sql(None)}, {SPLIT_SQL.replace('[0.7, 0.85]', '[0.02, 0.85]')}, c as (select split, unnest(list_concat(team_card_ids, opponent_card_ids)) card from split) select distinct card from c where card not in (select card from c where split = 'train')")
def cards_absent_from_train(spark, sf_dir):
    b = derived_battles(spark, sf_dir, None)
    b = prepare.split(b, prepare.cutoffs(b, shares=(0.02, 0.85)))
    return prepare.unseen_cards(b, b.where("split = 'train'"))


@register("card_weights", f"{BASE}, f as (select card, count(*) n from (select unnest(list_concat(team_card_ids, opponent_card_ids)) card from battles) group by 1), w as (select *, pow(1.0 / n, 0.5) w from f) select card, n, round(least(greatest(w / (select sum(n * w) / sum(n) from w), 0), 10), 6) weight from w")
def card_weights(spark, sf_dir):
    return rounded(prepare.inverse_weights(prepare.card_frequencies(derived_battles(spark, sf_dir))), "weight")


@register("sample_weights", f"{BASE}, f as (select card, count(*) n from (select unnest(list_concat(team_card_ids, opponent_card_ids)) card from battles) group by 1), w as (select *, pow(1.0 / n, 0.5) w from f), v as (select card, least(w / (select sum(n * w) / sum(n) from w), 10) weight from w), u as (select game_id, unnest(list_concat(team_card_ids, opponent_card_ids)) card from battles) select game_id, round(avg(weight), 6) weight from u join v using (card) group by 1")
def sample_weights(spark, sf_dir):
    b = derived_battles(spark, sf_dir)
    return rounded(prepare.sample_weights(b, prepare.inverse_weights(prepare.card_frequencies(b))), "weight")


@register("split_manifest", f"{BASE}, {SPLIT_SQL} select count(*) filter (split = 'train') train_rows, count(*) filter (split = 'validation') validation_rows, count(*) filter (split = 'test') test_rows, count(distinct case when split = 'train' then segment end) + 1 segment_vocabulary, count(distinct case when split = 'train' then patch end) + 1 patch_vocabulary, min(battle_time) first_time, max(battle_time) last_time, (select count(distinct card) + 1 from (select unnest(list_concat(team_card_ids, opponent_card_ids)) card from split where split = 'train')) card_vocabulary from split")
def split_manifest(spark, sf_dir):
    return prepare.manifest(split_battles(spark, sf_dir))


# Segments and labels ---------------------------------------------------------------------------------

ORDER_SEGMENTS = """select o_orderkey, case when o_orderkey % 11 = 0 then null else o_orderkey % 9 end league, case o_orderkey % 4 when 0 then 'Ranked' when 1 then 'ranked' when 2 then 'ladder' else 'Event' end mode,
       case when o_orderkey % 5 = 0 then cast(o_orderkey % 12000 as int) end rank, case when o_orderkey % 7 = 0 then null else cast(floor(o_totalprice / 25) as int) end trophies from orders"""


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.when(k % 11 != 0, k % 9).alias("league"), F.element_at(F.array(*[F.lit(m) for m in ("Ranked", "ranked", "ladder", "Event")]), (k % 4 + 1).cast("int")).alias("mode"),
        F.when(k % 5 == 0, (k % 12000).cast("int")).alias("rank"), F.when(k % 7 != 0, F.floor(F.col("o_totalprice") / 25).cast("int")).alias("trophies"),
    )


RANKED_CASE = "case when league is null then 'ranked:unknown' when league >= 1 and league < 3 then 'ranked:league-1-2' when league >= 3 and league < 5 then 'ranked:league-3-4' when league >= 5 and league < 8 then 'ranked:league-5-7' else 'ranked:league-' || league end"
BANDS = [(0, 5000), (5000, 7000), (7000, 9000), (9000, 12000), (12000, 14000), (14000, 999999)]
BAND_CASE = " ".join(f"when trophies >= {a} and trophies < {b} then 'ladder:{a}-{b - 1}'" for a, b in BANDS)
SEGMENT_CASE = f"case when lower(mode) = 'ranked' then {RANKED_CASE} when lower(mode) <> 'ladder' then lower(mode) when rank > 0 then case when rank <= 100 then 'ladder:top-100' when rank <= 1000 then 'ladder:top-1000' when rank <= 10000 then 'ladder:top-10000' else 'ladder:ranked-other' end when trophies is null then 'ladder:unknown' {BAND_CASE} else 'ladder:overflow' end"


@register("segment_rules", f"with s as ({ORDER_SEGMENTS}) select o_orderkey, {SEGMENT_CASE} segment from s")
def segment_rules(spark, sf_dir):
    s = order_segments(spark, sf_dir)
    return s.select("o_orderkey", segments.segment(F.col("mode"), F.col("league"), F.col("rank"), F.col("trophies")).alias("segment"))


EXACT = "case when lower(mode) = 'ranked' then coalesce('ranked:league-' || league, 'ranked:unknown') else 'ladder:' || coalesce(trophies // 5000 * 5000, 0) || '-' || (coalesce(trophies // 5000 * 5000, 0) + 4999) end"


def exact_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_segments(spark, sf_dir)
    low = F.coalesce(F.floor(F.col("trophies") / 5000) * 5000, F.lit(0))
    ladder = F.concat(F.lit("ladder:"), low.cast("string"), F.lit("-"), (low + 4999).cast("string"))
    ranked = F.coalesce(F.concat(F.lit("ranked:league-"), F.col("league").cast("string")), F.lit("ranked:unknown"))
    return s.withColumn("segment", F.when(F.lower("mode") == "ranked", ranked).otherwise(ladder))


LEAGUE_SQL = "try_cast(regexp_extract(segment, '^ranked:league-([0-9]+)$', 1) as integer)"
POOL_SQL = f"case when {LEAGUE_SQL} >= 1 and {LEAGUE_SQL} < 3 then 'ranked:league-1-2' when {LEAGUE_SQL} >= 3 and {LEAGUE_SQL} < 5 then 'ranked:league-3-4' when {LEAGUE_SQL} >= 5 and {LEAGUE_SQL} < 8 then 'ranked:league-5-7' else segment end"


@register("ranked_pooling", f"with s as (select *, {EXACT} segment from ({ORDER_SEGMENTS})) select o_orderkey, case when lower(mode) = 'ranked' then {POOL_SQL} else segment end any_case, case when mode = 'ranked' then {POOL_SQL} else segment end lower_only, case when segment like 'ranked:league-%' then {POOL_SQL} else segment end by_name from s")
def ranked_pooling(spark, sf_dir):
    s, c = exact_segments(spark, sf_dir), F.col("segment")
    return s.select("o_orderkey", segments.pooled(c, F.col("mode")).alias("any_case"), segments.pooled(c, F.col("mode"), any_case=False).alias("lower_only"), segments.pooled(c).alias("by_name"))


LOWER_SQL = "case when segment like 'ladder:%' then try_cast(split_part(split_part(segment, ':', 2), '-', 1) as integer) end"
REALIGN_CASE = " ".join(f"when {LOWER_SQL} >= {a} and {LOWER_SQL} < {b} then 'ladder:{a}-{b - 1}'" for a, b in BANDS)


@register("legacy_bands", f"with s as (select *, {EXACT} segment from ({ORDER_SEGMENTS})) select case {REALIGN_CASE} else segment end segment, count(*) n, count(*) filter (segment like 'ranked:%' or {LOWER_SQL} >= 5000) tracked from s group by 1")
def legacy_bands(spark, sf_dir):
    s, c = exact_segments(spark, sf_dir), F.col("segment")
    return s.withColumn("keep", segments.tracked(c, 5000)).withColumn("segment", segments.realigned(c)).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("tracked"))


MODE_SQL = "case when kind in ('pathoflegend', 'pathoflegends') or name like 'ranked%' then 'ranked' when kind = 'pvp' or name like 'ladder%' or name like 'seasonal%' then 'ladder' else 'other' end"
MODES_SQL = "select o_orderkey, lower(case o_orderkey % 4 when 0 then 'pathOfLegend' when 1 then 'PvP' when 2 then 'trail' end) kind, lower(case o_orderkey % 5 when 0 then 'Ranked1v1' when 1 then 'Seasonal' when 2 then 'Ladder' else 'x' end) name from orders"


@register("mode_keys", f"select o_orderkey, {MODE_SQL} mode from (select o_orderkey, coalesce(kind, '') kind, name from ({MODES_SQL}))")
def mode_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "pathOfLegend").when(k % 4 == 1, "PvP").when(k % 4 == 2, "trail")
    name = F.when(k % 5 == 0, "Ranked1v1").when(k % 5 == 1, "Seasonal").when(k % 5 == 2, "Ladder").otherwise("x")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", segments.mode_of(kind, name).alias("mode"))


@register("prior_buckets", f"with s as (select {SEGMENT_CASE} segment from ({ORDER_SEGMENTS})) select case when segment in ('ladder:0-4999', 'ladder:7000-8999', 'ladder:9000-11999', 'ladder:12000-99998') or segment like 'ladder:top-%' then segment else 'unknown' end bucket, case when segment in ('ranked:league-1-2', 'ladder:5000-6999') then segment else 'ladder:5000-6999' end served, count(*) n from s group by all")
def prior_buckets(spark, sf_dir):
    s = order_segments(spark, sf_dir)
    c = segments.segment(F.col("mode"), F.col("league"), F.col("rank"), F.col("trophies"))
    return s.groupBy(segments.prior_bucket(c).alias("bucket"), segments.served(c, ["ranked:league-1-2", "ladder:5000-6999"], "ladder:5000-6999").alias("served")).agg(F.count(F.lit(1)).alias("n"))


@register("segment_backfill", f"with s as (select *, {EXACT} segment from ({ORDER_SEGMENTS})), l as (select o_orderkey k, o_orderkey % 6 found from orders where o_orderpriority = '1-URGENT') select s.o_orderkey, case when lower(mode) = 'ranked' and segment not like 'ranked:league-%' then case when found > 0 then 'ranked:league-' || found else 'ranked:unknown' end else segment end segment from s left join l on s.o_orderkey = l.k")
def segment_backfill(spark, sf_dir):
    s = exact_segments(spark, sf_dir)
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 6).alias("found"))
    return s.join(found, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", segments.backfilled(F.col("segment"), F.lower("mode"), F.col("found")).alias("segment"))


@register("segment_diagnostics", f"with s as (select *, {EXACT} segment from ({ORDER_SEGMENTS})) select segment, count(*) games, round(count(*)::double / sum(count(*)) over (), 6) share, segment = 'ranked:unknown' as unknown from s where segment like 'ranked:%' group by 1")
def segment_diagnostics(spark, sf_dir):
    return rounded(prepare.segment_diagnostics(exact_segments(spark, sf_dir)), "share")


@register("probability_labels", f"{BASE}, {PREDICTIONS_SQL}, q as (select game_id, round(probability - 0.1 + 0.05 * (game_id % 5), 2) p from predictions) select game_id, case when p < 0.4 then 'very_bad' when p < 0.45 then 'bad' when p <= 0.55 then 'neutral' when p <= 0.6 then 'good' else 'very_good' end five, case when p >= 0.55 then 'good' when p <= 0.45 then 'bad' else 'neutral' end served, case when p < 0.45 then 'bad' when p > 0.55 then 'good' else 'neutral' end meta, case when abs(p - 0.5) < 0.04 then 'low' when abs(p - 0.5) >= 0.12 then 'high' else 'medium' end confidence from q")
def probability_labels(spark, sf_dir):
    p = predictions(derived_battles(spark, sf_dir)).select("game_id", F.round(F.col("probability") - 0.1 + F.lit(0.05) * (F.col("game_id") % 5), 2).alias("p"))
    return p.select("game_id", *[f(F.col("p")).alias(f.__name__) for f in (labels.five, labels.served, labels.meta, labels.confidence)])


# Unseen matchups -------------------------------------------------------------------------------------


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = split_battles(spark, sf_dir, card_universe(spark, sf_dir))
    return unseen.mark_unseen(b.where("split = 'train'"), b.where("split = 'test'"))


KEY_SQL = "case when team_deck_key <= opponent_deck_key then team_deck_key || '::' || opponent_deck_key else opponent_deck_key || '::' || team_deck_key end"
MARKED_SQL = f"""with {battles_sql(GROWING)}, {SPLIT_SQL}, keyed as (select *, {KEY_SQL} matchup_key from split),
    tm as (select distinct matchup_key k, 1 hit from keyed where split = 'train'),
    td as (select team_deck_key deck from keyed where split = 'train' union select opponent_deck_key from keyed where split = 'train'),
    marked as (select e.*, tm.hit is null is_unseen, a.deck is not null team_seen, b.deck is not null opponent_seen from keyed e
               left join tm on e.matchup_key = tm.k left join td a on e.team_deck_key = a.deck left join td b on e.opponent_deck_key = b.deck where split = 'test')"""
LEVEL_SQL = " union all ".join(f"select '{n}' as level, '{d}' as difficulty, count(*) filter ({c}) as rows, count(distinct case when {c} then matchup_key end) matchups, round(count(*) filter ({c}) / nullif(count(*), 0)::double, 6) row_share from marked" for n, (d, c) in unseen.LEVELS.items())


@register("matchup_keys", f"with {battles_sql(None)} select {KEY_SQL} matchup_key, count(*) n from battles group by 1")
def matchup_keys(spark, sf_dir):
    return derived_battles(spark, sf_dir, None).groupBy(matchup_key(F.col("team_deck_key"), F.col("opponent_deck_key")).alias("matchup_key")).agg(F.count(F.lit(1)).alias("n"))


@register("unseen_levels", f"{MARKED_SQL} {LEVEL_SQL}")
def unseen_levels(spark, sf_dir):
    return rounded(unseen.levels(marked(spark, sf_dir)), "row_share")


@register("unseen_rows", f"{MARKED_SQL} select game_id, matchup_key from marked where is_unseen and team_seen != opponent_seen")
def unseen_rows(spark, sf_dir):
    return unseen.level_rows(marked(spark, sf_dir), "one_new_deck").select("game_id", "matchup_key")


@register("unseen_strict_split", f"{MARKED_SQL} select count(*) test_rows, count(*) filter (not is_unseen) excluded_seen_rows, count(*) filter (is_unseen) strict_rows from marked")
def unseen_strict_split(spark, sf_dir):
    return unseen.strict_split(marked(spark, sf_dir))


# Deck populations ------------------------------------------------------------------------------------


@register("deck_play_counts", f"{PLAYS_SQL} select * from plays where plays >= 3")
def deck_play_counts(spark, sf_dir):
    return deck_stats.play_counts(sides(deck_stats.without_top_ranks(derived_battles(spark, sf_dir))), 3)


ORIENTED_SQL = f"{WITH_SIDES}, oriented as (select segment, deck_key, count(*) filter (side = 'team') team_n, count(*) filter (side = 'opponent') opponent_n, count(*) filter (side = 'team' and won) team_wins, count(*) filter (side = 'opponent' and won) opponent_wins from sides group by all)"
SHRUNK_SQL = "(case when team_n + 10 <= 0 then 0.5 else (team_wins + 5.0) / (team_n + 10.0) end + case when opponent_n + 10 <= 0 then 0.5 else (opponent_wins + 5.0) / (opponent_n + 10.0) end) / 2"


@register("oriented_deck_stats", f"{ORIENTED_SQL} select * from oriented")
def oriented_deck_stats(spark, sf_dir):
    return deck_stats.oriented(sides(derived_battles(spark, sf_dir)))


@register("balanced_win_rate", f"{ORIENTED_SQL} select segment, deck_key, round((team_wins::double / nullif(team_n, 0) + opponent_wins::double / nullif(opponent_n, 0)) / 2, 6) rate from oriented")
def balanced_win_rate(spark, sf_dir):
    return rounded(deck_stats.oriented(sides(derived_battles(spark, sf_dir))).select("segment", "deck_key", deck_stats.balanced_rate().alias("rate")), "rate")


def best_decks(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """The flagship: each segment's best decks by orientation-balanced, shrunk win rate."""
    stats = deck_stats.oriented(sides(derived_battles(spark, sf_dir)))
    rate = deck_stats.shrunk_mean(F.col("team_wins"), F.col("team_n"), F.col("opponent_wins"), F.col("opponent_n"), 0.5, 20.0)
    stats = rounded(stats.withColumn("rate", rate), "rate").withColumn("n", F.col("team_n") + F.col("opponent_n"))
    return deck_stats.rank_within(stats, "segment", F.desc("rate"), F.desc("n"), F.col("deck_key")).where(F.col("rank") <= top).select("segment", "rank", "deck_key", "rate", "n")


@register("best_decks", f"{ORIENTED_SQL}, r as (select segment, deck_key, round({SHRUNK_SQL}, 6) rate, team_n + opponent_n n from oriented) select segment, cast(rank as int) rank, deck_key, rate, n from (select *, row_number() over (partition by segment order by rate desc, n desc, deck_key) rank from r) where rank <= 3")
def _best_decks(spark, sf_dir):
    return best_decks(spark, sf_dir)


SPLIT_STATS = ", ".join(["count(*) filter (t <= c1) train_n"] + [f"count(*) filter ({w}) {s}_n, count(*) filter ({w} and won) {s}_wins, " + ", ".join(f"count(*) filter ({w} and side = '{x}') {s}_{x}_n, count(*) filter ({w} and side = '{x}' and won) {s}_{x}_wins" for x in ("team", "opponent")) for s, w in (("validation", "t > c1 and t <= c2"), ("test", "t > c2"))])


@register("deck_split_stats", f"{WITH_SIDES}, {CUTS} select segment, deck_key, {SPLIT_STATS} from (select s.*, epoch(battle_time) t, {CUT_COLUMNS} from sides s, cuts) group by all")
def deck_split_stats(spark, sf_dir):
    b = derived_battles(spark, sf_dir)
    cuts = prepare.cutoffs(b)
    seconds = sides(b).withColumn("battle_time", prepare.micros(F.col("battle_time")) / 1e6)
    return deck_stats.split_stats(seconds, cuts)


@register("segment_deck_rank", f"{PLAYS_SQL} select segment, deck_key, plays, cast(row_number() over (partition by segment order by plays desc, deck_key) as int) rank from plays")
def segment_deck_rank(spark, sf_dir):
    return deck_stats.rank_within(plays_of(spark, sf_dir), "segment", F.desc("plays"), F.col("deck_key")).drop("wins")


PANEL_SQL = f"{PLAYS_SQL}, panel as (select *, plays::double / sum(plays) over (partition by segment) weight from (select segment, deck_key, plays, row_number() over (partition by segment order by plays desc, deck_key) rank from plays) where rank <= 20)"


@register("panel_weights", f"{PANEL_SQL} select segment, deck_key, plays, cast(rank as int) rank, round(weight, 6) weight from panel")
def panel_weights(spark, sf_dir):
    return rounded(deck_stats.panel(plays_of(spark, sf_dir), 20).drop("wins"), "weight")


@register("screen_panel", f"{PANEL_SQL}, s as (select * from panel where rank - 1 in (select cast(floor(i * 19 / 6.0) as int) from range(0, 7) t(i))) select segment, deck_key, round(weight / sum(weight) over (partition by segment), 6) weight from s")
def screen_panel(spark, sf_dir):
    return rounded(deck_stats.screen_panel(deck_stats.panel(plays_of(spark, sf_dir), 20), 7).select("segment", "deck_key", "weight"), "weight")


@register("card_pool", f"{PLAYS_SQL}, top as (select * from (select *, row_number() over (partition by segment order by plays desc, deck_key) r from plays) where r <= 30), u as (select segment, cast(c as bigint) card, cast(sum(plays) as bigint) uses from (select segment, plays, unnest(string_split(deck_key, ',')) c from top) group by all) select segment, card, uses, cast(rank as int) rank from (select *, row_number() over (partition by segment order by uses desc, card) rank from u) where rank <= 4")
def card_pool(spark, sf_dir):
    return deck_stats.usage(plays_of(spark, sf_dir), 30, 4)


PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def _percentile_sql(weight: str, clamp: bool) -> str:
    pick = lambda s: f"min(case when share >= {s} then plays end)"
    names = ", ".join(f"{f'coalesce({pick(s)}, max(plays))' if clamp else pick(s)} {deck_stats.name(s)}" for s in PERCENTILES)
    return f"{PLAYS_SQL}, c as (select segment, plays, sum({weight}) w from plays group by all), s as (select *, sum(w) over (partition by segment order by plays rows unbounded preceding)::double / sum(w) over (partition by segment) share from c) select segment, {names} from s group by 1"


@register("weighted_percentiles", _percentile_sql("plays", False))
def weighted_percentiles(spark, sf_dir):
    return deck_stats.weighted_percentiles(plays_of(spark, sf_dir), "plays", "plays", PERCENTILES, ["segment"])


@register("clamped_percentiles", _percentile_sql("1", True))
def clamped_percentiles(spark, sf_dir):
    return deck_stats.weighted_percentiles(plays_of(spark, sf_dir), "plays", None, PERCENTILES, ["segment"], clamp=True)


@register("linear_percentiles", f"{PLAYS_SQL} select segment, " + ", ".join(f"round(quantile_cont(plays, {s}), 6) {deck_stats.name(s)}" for s in PERCENTILES) + ", round(avg(plays), 6) mean, round(stddev_pop(plays), 6) std from plays group by 1")
def linear_percentiles(spark, sf_dir):
    out = deck_stats.linear_percentiles(plays_of(spark, sf_dir), "plays", PERCENTILES, ["segment"])
    return rounded(out, *[deck_stats.name(s) for s in PERCENTILES], "mean", "std")


@register("rank_of", f"{PLAYS_SQL} select segment, deck_key, round((select count(*) from plays r where r.plays < p.plays and r.segment = '1-URGENT') / (select count(*)::double from plays where segment = '1-URGENT'), 6) below from plays p where segment <> '1-URGENT'")
def rank_of(spark, sf_dir):
    p = plays_of(spark, sf_dir).drop("wins")
    urgent = p.where("segment = '1-URGENT'").select(F.col("plays").alias("r"))
    return rounded(deck_stats.share_below(p.where("segment <> '1-URGENT'"), "plays", urgent, "r").drop("plays"), "below")


@register("score_bands", f"{PLAYS_SQL}, r as (select *, wins::double / plays rate from plays), b as (select *, case when rate >= 0 and rate < 0.4 then 0 when rate >= 0.4 and rate < 0.5 then 1 when rate >= 0.5 and rate < 0.6 then 2 when rate >= 0.6 and rate <= 1 then 3 end band from r) select band, count(*) decks, cast(sum(plays) as bigint) plays, round(avg(rate), 6) rate from b group by 1")
def score_bands(spark, sf_dir):
    r = plays_of(spark, sf_dir).withColumn("rate", F.col("wins") / F.col("plays"))
    return rounded(deck_stats.bands(r, "rate", (0, 0.4, 0.5, 0.6, 1), [F.count(F.lit(1)).alias("decks"), F.sum("plays").alias("plays"), F.avg("rate").alias("rate")]), "rate")
