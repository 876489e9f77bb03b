"""Registered queries of the analytic operators: metrics, co-occurrence, composition, neighbours, selection, priors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions.decks import deck_cards
from tiltyard.operators import composition, cooccurrence, correction, deck_stats, metrics, neighbours, prepare, prior
from tiltyard.plans.tables import BASE, KEY_SQL, PLAYS_SQL, SPLIT_SQL, WITH_SIDES, plays_of, rounded, split_battles
from tiltyard.sources.battles import GROWING, PREDICTIONS_SQL, battles_sql, card_universe, derived_battles, matchup_key, predictions, sides, swapped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that differ from game to game, so that ranks and bins have something to order."""
    p = predictions(derived_battles(spark, sf_dir))
    return p.withColumn("probability", F.round(F.col("probability") + F.lit(0.001) * (F.col("game_id") % 40), 3))


P_SQL = f"{BASE}, {PREDICTIONS_SQL}, p as (select game_id, segment, team_deck_key, opponent_deck_key, target, round(probability + 0.001::double * (game_id % 40), 3) probability from predictions)"
Y, Q = "target::int", "least(greatest(probability, 1e-6), 1 - 1e-6)"
LOSSES = f"round(avg((({Q} >= 0.5) = target)::int), 6) accuracy, round(avg(-({Y} * ln({Q}) + (1 - {Y}) * ln(1 - {Q}))), 6) log_loss, round(avg(({Q} - {Y}) * ({Q} - {Y})), 6) brier_score"
AUC = "round((sum(case when target then r end) - count(*) filter (target) * (count(*) filter (target) + 1) / 2.0::double) / nullif(count(*) filter (target)::double * count(*) filter (not target), 0), 6) auc"


# Metrics ---------------------------------------------------------------------------------------------


@register("scalar_metrics", f"{P_SQL}, k as (select *, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0::double r from p) select count(*) as rows, {LOSSES}, {AUC} from k")
def scalar_metrics(spark, sf_dir):
    return rounded(metrics.scalar_metrics(predicted(spark, sf_dir)), "accuracy", "log_loss", "brier_score", "auc")


@register("metrics_by_segment", f"{P_SQL}, k as (select *, rank() over (partition by segment order by probability) + (count(*) over (partition by segment, probability) - 1) / 2.0::double r from p) select segment, count(*) as rows, {LOSSES}, {AUC} from k group by 1")
def metrics_by_segment(spark, sf_dir):
    return rounded(metrics.scalar_metrics(predicted(spark, sf_dir), ["segment"]), "accuracy", "log_loss", "brier_score", "auc")


@register("auc_midrank", f"{P_SQL}, k as (select *, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0::double r from p) select {AUC} from k")
def auc_midrank(spark, sf_dir):
    return rounded(metrics.auc(predicted(spark, sf_dir)), "auc")


FIXED_SQL = "f as (select b.bin, count(*) as count, avg(probability) mean_prediction, avg(target::int) observed_rate from p join (select unnest(range(0, 10)) bin) b on probability >= b.bin / 10.0::double and (probability < (b.bin + 1) / 10.0::double or (b.bin = 9 and probability <= 1)) group by 1)"


@register("calibration_fixed", f"{P_SQL}, {FIXED_SQL} select cast(bin as int) bin, count, round(mean_prediction, 6) mean_prediction, round(observed_rate, 6) observed_rate, round(bin / 10.0::double, 6) as lower, round((bin + 1) / 10.0::double, 6) as upper, round(abs(mean_prediction - observed_rate), 6) absolute_error from f")
def calibration_fixed(spark, sf_dir):
    return rounded(metrics.fixed_calibration(predicted(spark, sf_dir)), "mean_prediction", "observed_rate", "lower", "upper", "absolute_error")


QUANTILE_SQL = "t as (select *, ntile(15) over (order by probability, game_id) bin from p), q as (select bin, count(*) as count, avg(probability) mean_prediction, avg(target::int) observed_rate from t group by 1)"


@register("calibration_quantile", f"{P_SQL}, {QUANTILE_SQL} select cast(bin as int) bin, count, round(mean_prediction, 6) mean_prediction, round(observed_rate, 6) observed_rate, round(abs(mean_prediction - observed_rate), 6) absolute_error from q")
def calibration_quantile(spark, sf_dir):
    return rounded(metrics.quantile_calibration(predicted(spark, sf_dir), "game_id"), "mean_prediction", "observed_rate", "absolute_error")


@register("ece", f"{P_SQL}, {FIXED_SQL}, {QUANTILE_SQL} select round((select sum(count * abs(mean_prediction - observed_rate)) / sum(count) from f), 6) fixed, round((select sum(count * abs(mean_prediction - observed_rate)) / sum(count) from q), 6) as quantile")
def ece(spark, sf_dir):
    p = predicted(spark, sf_dir)
    fixed = metrics.expected_error(metrics.fixed_calibration(p)).withColumnRenamed("ece", "fixed")
    return rounded(fixed.crossJoin(metrics.expected_error(metrics.quantile_calibration(p, "game_id")).withColumnRenamed("ece", "quantile")), "fixed", "quantile")


# Newton's method in SQL: sums over equal probabilities, and a step of two numbers at a time.
LINE_SQL = f"""{P_SQL.replace("with", "with recursive", 1)},
 l as (select least(greatest(probability, 1e-6), 1 - 1e-6) q, target::int y from p),
 g as (select ln(q / (1 - q)) x, count(*)::double n, sum(y)::double y from l group by 1),
 it as (
  select 0 k, 1.0::double s, 0.0::double i
  union all
  select k + 1, s + (a * r1 - b * r0) / (a * c - b * b), i + (c * r0 - b * r1) / (a * c - b * b) from (
   select k, s, i, sum(y - n * f) r0, sum((y - n * f) * x) r1, sum(n * f * (1 - f)) a, sum(n * f * (1 - f) * x) b, sum(n * f * (1 - f) * x * x) c
   from (select it.k, it.s, it.i, g.x, g.n, g.y, 1 / (1 + exp(-(it.s * g.x + it.i))) f from it, g where it.k < 25) group by k, s, i))
select round(s, 6) slope, round(i, 6) intercept from it where k = 25"""


@register("calibration_line", LINE_SQL)
def calibration_line(spark, sf_dir):
    slope, intercept = metrics.calibration_line(predicted(spark, sf_dir))
    return rounded(spark.createDataFrame([(slope, intercept)], "slope double, intercept double"), "slope", "intercept")


@register("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    return metrics.bootstrap(predicted(spark, sf_dir), "game_id", 100)


FLOOR_SQL = f"{BASE}, k as (select win target, {KEY_SQL} matchup_key from battles), m as (select matchup_key, count(*) n, avg(target::int) p from k group by 1), s as (select k.*, m.n, m.p from k join m using (matchup_key) where n >= 5)"


@register("noise_floor", f"{FLOOR_SQL} select 5 min_support, (select count(*) from m) observed_matchups, (select count(*) from m where n >= 5) supported_matchups, count(*) supported_rows, round(count(*)::double / (select count(*) from k), 6) coverage, round(avg(p * (1 - p)), 6) irreducible_brier, round(avg(-(target::int * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - target::int) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) oracle_log_loss, round(avg(greatest(p, 1 - p)), 6) oracle_accuracy from s")
def noise_floor(spark, sf_dir):
    b = derived_battles(spark, sf_dir).select(F.col("win").alias("target"), matchup_key(F.col("team_deck_key"), F.col("opponent_deck_key")).alias("matchup_key"))
    return rounded(metrics.noise_floor(b, "matchup_key", 5), "coverage", "irreducible_brier", "oracle_log_loss", "oracle_accuracy")


MODELS = ("prior", "model", "constant")
BENCH_SQL = f"{P_SQL}, k as (select *, {KEY_SQL} matchup_key from p), m as (select matchup_key, avg(target::int) rate from k group by 1 having count(*) >= 5), l as (" + " union all ".join(
    f"select '{n}' model, target, {e} probability, rate from k left join m using (matchup_key)" for n, e in (("prior", "0.5::double + (probability - 0.5) / 4"), ("model", "probability"), ("constant", "0.5::double"))
) + f"), a as (select model, count(*) as rows, {LOSSES} from l group by 1), r as (select model, {AUC} from (select *, rank() over (partition by model order by probability) + (count(*) over (partition by model, probability) - 1) / 2.0::double r from l) group by 1), f as (select model, avg(({Q} - {Y}) * ({Q} - {Y})) sb, avg(rate * (1 - rate)) ib from l where rate is not null group by 1)"


@register("benchmark_report", f"{BENCH_SQL} select a.*, r.auc, round(sb, 6) supported_brier, round(ib, 6) irreducible_brier, round(sb - ib, 6) gap_to_floor, round(case when (select sb from f where model = 'prior') - ib > 0 then ((select sb from f where model = 'prior') - sb) / ((select sb from f where model = 'prior') - ib) end, 6) headroom_captured from a join r using (model) left join f using (model)")
def benchmark_report(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("matchup_key", matchup_key(F.col("team_deck_key"), F.col("opponent_deck_key")))
    p = p.withColumns({"prior": F.lit(0.5) + (F.col("probability") - 0.5) / 4, "model": F.col("probability"), "constant": F.lit(0.5)})
    out = metrics.benchmark(p, "matchup_key", MODELS, 5)
    return rounded(out, "accuracy", "log_loss", "brier_score", "auc", "supported_brier", "irreducible_brier", "gap_to_floor", "headroom_captured")


CLASS = "case when {0} < 0.45 then 'bad' when {0} > 0.55 then 'good' else 'neutral' end"


@register("meta_report", f"{P_SQL}, pairs as (select segment, team_deck_key, opponent_deck_key, count(*) n, avg(probability) pr, avg(target::int) ob from p group by all), s as (select *, {CLASS.format('pr')} pc, {CLASS.format('ob')} oc from pairs where n >= 3) select (select count(*) from p) test_games, (select count(*) from pairs) observed_exact_matchups, count(*) supported_matchups, cast(coalesce(sum(n), 0) as bigint) supported_games, round(coalesce(sum(n)::double / (select count(*) from p), 0), 6) coverage, round(coalesce(sum(n * (pc = oc)::int)::double / nullif(sum(n), 0), 0), 6) meta_weighted_class_accuracy, round(coalesce(avg(abs(pr - ob)), 0), 6) matchup_mae, round(coalesce(sum(n * abs(pr - ob)) / nullif(sum(n), 0), 0), 6) matchup_mae_weighted from s")
def meta_report(spark, sf_dir):
    return rounded(metrics.meta_report(predicted(spark, sf_dir), 3), "coverage", "meta_weighted_class_accuracy", "matchup_mae", "matchup_mae_weighted")


@register("class_distribution", f"{P_SQL} select {CLASS.format('probability')} matchup_class, count(*) games, round(count(*)::double / sum(count(*)) over (), 6) meta_share from p group by 1")
def class_distribution(spark, sf_dir):
    return rounded(metrics.class_distribution(predicted(spark, sf_dir)), "meta_share")


C_SQL = "least(greatest(v, 1e-7), 1 - 1e-7)"


@register("calibration_variants", f"{P_SQL}, l as (select segment, 'raw' variant, target::int y, probability v from p union all select segment, 'projected', target::int, 0.5::double * (probability + 1 - (0.98::double - probability)) from p union all select segment, 'warm', target::int, 1 / (1 + exp(-ln(probability / (1 - probability)) / 1.5::double)) from p) select segment, variant, count(*) as rows, round(avg(({C_SQL} - y) * ({C_SQL} - y)), 6) brier, round(avg(-(y * ln({C_SQL}) + (1 - y) * ln(1 - {C_SQL}))), 6) log_loss, round(avg({C_SQL}), 6) mean_probability, round(avg(y), 6) observed_rate, round(avg({C_SQL} - y), 6) bias from l group by all")
def calibration_variants(spark, sf_dir):
    p, raw = predicted(spark, sf_dir), F.col("probability")
    p = p.withColumns({"raw": raw, "projected": correction.projected(raw, F.lit(0.98) - raw), "warm": correction.sigmoid(correction.logit(raw) / 1.5)})
    return rounded(metrics.compare_calibrations(p, ("raw", "projected", "warm")), "brier", "log_loss", "mean_probability", "observed_rate", "bias")


# Cards together --------------------------------------------------------------------------------------

DECKS_SQL = f"with {battles_sql(None)}, ds as (select segment, team_deck_key deck_key, team_card_ids cards from battles union all select segment, opponent_deck_key, opponent_card_ids from battles), decks as (select deck_key, any_value(cards) cards, count(*) plays from ds group by 1)"


def decks_of(spark: SparkSession, sf_dir: str, universe: int | None = None) -> DataFrame:
    return sides(derived_battles(spark, sf_dir, universe)).groupBy("deck_key").agg(F.first("cards").alias("cards"), F.count(F.lit(1)).alias("plays"))


PAIRS_SQL = "e as (select deck_key, plays, unnest(cards) c from decks), pr as (select a.deck_key, a.plays, a.c a, b.c b from e a join e b on a.deck_key = b.deck_key and a.c < b.c), pc as (select a, b, cast(sum(plays) as bigint) n from pr group by all), cc as (select c, sum(plays) n from e group by 1)"


@register("card_pairs", f"{DECKS_SQL}, {PAIRS_SQL} select a, b, n from pc")
def card_pairs(spark, sf_dir):
    return cooccurrence.pair_counts(decks_of(spark, sf_dir), weight="plays")


PMI_SQL = "pm as (select pc.a, pc.b, pc.n, ln(greatest(pc.n / t.t, 1 / t.t) / greatest(x.n / t.t * y.n / t.t, 1e-12)) pmi from pc join cc x on pc.a = x.c join cc y on pc.b = y.c, (select sum(plays)::double t from decks) t)"


@register("pmi_pairs", f"{DECKS_SQL}, {PAIRS_SQL}, {PMI_SQL} select a, b, n, round(pmi, 6) pmi from pm")
def pmi_pairs(spark, sf_dir):
    return rounded(cooccurrence.pmi(decks_of(spark, sf_dir)), "pmi")


@register("deck_mean_pmi", f"{DECKS_SQL}, {PAIRS_SQL}, {PMI_SQL} select deck_key, round(avg(pmi), 6) mean_pmi, round(min(pmi), 6) min_pmi, cast(0 as bigint) unseen_pairs from pr join pm using (a, b) group by 1")
def deck_mean_pmi(spark, sf_dir):
    d = decks_of(spark, sf_dir)
    return rounded(cooccurrence.deck_pmi(d, d), "mean_pmi", "min_pmi")


@register("ppmi", f"{DECKS_SQL}, {PAIRS_SQL.replace('sum(plays) as bigint', 'count(*) as bigint')}, sym as (select a, b, n from pc union all select b, a, n from pc), r as (select a, sum(n) s from sym group by 1) select pc.a, pc.b, pc.n, round(greatest(ln(pc.n * (select sum(s) from r)::double / (x.s::double * y.s)), 0), 6) ppmi from pc join r x on pc.a = x.a join r y on pc.b = y.a")
def ppmi(spark, sf_dir):
    return rounded(cooccurrence.ppmi(cooccurrence.pair_counts(decks_of(spark, sf_dir))), "ppmi")


@register("card_embeddings")
def card_embeddings(spark, sf_dir):
    cards, vectors = cooccurrence.embeddings(cooccurrence.pair_counts(decks_of(spark, sf_dir, 120)), 4)
    return spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(cards, vectors)], "card bigint, vector array<double>")


MET_SQL = DECKS_SQL.replace(battles_sql(None), battles_sql(GROWING))  # decks that meet again
GROUPS_SQL = "e as (select deck_key, plays, unnest(cards) c from decks), gr as (select x.deck_key, x.plays, x.c || ',' || y.c || ',' || z.c card_group from e x join e y on x.deck_key = y.deck_key and x.c < y.c join e z on y.deck_key = z.deck_key and y.c < z.c), gc as (select card_group, cast(sum(plays) as bigint) n from gr group by 1)"


@register("triple_groups", f"{MET_SQL}, {GROUPS_SQL} select * from gc")
def triple_groups(spark, sf_dir):
    return cooccurrence.group_counts(decks_of(spark, sf_dir, card_universe(spark, sf_dir)), 3)


@register("unattested_groups", f"{MET_SQL}, {GROUPS_SQL} select deck_key, count(*) as groups, count(*) filter (n < 8) unattested, min(n) weakest from gr join gc using (card_group) group by 1")
def unattested_groups(spark, sf_dir):
    d = decks_of(spark, sf_dir, card_universe(spark, sf_dir))
    return cooccurrence.unattested(d, cooccurrence.group_counts(d, 3), 3, 8)


@register("attested_groups", f"{MET_SQL}, {GROUPS_SQL.replace('from decks)', 'from decks where plays >= 2)')} select distinct card_group from gr")
def attested_groups(spark, sf_dir):
    return cooccurrence.attested(decks_of(spark, sf_dir, card_universe(spark, sf_dir)), 3, 2)


# Composition -----------------------------------------------------------------------------------------

ROLE_RULES = (("win-condition", "c % 4 = 0"), ("spell-small", "c % 5 = 1"), ("anti-air", "c % 3 = 0"), ("splash-damage", "c % 3 = 1"), ("tank-killer", "c % 4 = 3"), ("spell-heavy", "c % 5 = 2"), ("spell-utility", "c = 7"))
CATALOGUE_SQL = (
    "cat as (select p_partkey card, list_filter(["
    + ", ".join(f"case when {t.replace('c ', 'p_partkey ')} then '{r}' end" for r, t in ROLE_RULES)
    + ", 'role-' || p_partkey], lambda x: x is not null) roles, case p_partkey % 5 when 1 then 'spell' when 2 then 'spell' when 3 then 'building' else 'troop' end kind, "
    "case p_partkey % 2 when 0 then 'air-and-ground' else 'ground' end targets, case p_partkey % 3 when 0 then 'air' else 'ground' end transport, p_size % 7 elixir from part)"
)


def catalogue_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card made from every part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("c", F.col("p_partkey"))
    roles = F.array_compact(F.array(*[F.when(F.expr(t), r) for r, t in ROLE_RULES], F.concat(F.lit("role-"), F.col("c").cast("string"))))
    kind = F.when(F.expr("c % 5 in (1, 2)"), "spell").when(F.expr("c % 5 = 3"), "building").otherwise("troop")
    return p.select(F.col("c").alias("card"), roles.alias("roles"), kind.alias("kind"), F.when(F.expr("c % 2 = 0"), "air-and-ground").otherwise("ground").alias("targets"), F.when(F.expr("c % 3 = 0"), "air").otherwise("ground").alias("transport"), (F.col("p_size") % 7).alias("elixir"))


HAS = "coalesce(list_contains(roles, '{0}'), false)"
FEATURES_SQL = f"""{CATALOGUE_SQL}, fe as (select deck_key, plays, unnest(cards) c from decks), ft as (select deck_key, any_value(plays) plays,
    count(*) filter ({HAS.format('win-condition')}) win_conditions, count(*) filter ({HAS.format('spell-small')}) small_spells, count(*) filter (kind = 'spell') any_spells,
    count(*) filter ({HAS.format('spell-medium')}) medium_spells, count(*) filter ({HAS.format('spell-heavy')}) heavy_spells,
    count(*) filter (coalesce(targets = 'air-and-ground', false) or {HAS.format('anti-air')} or (coalesce(kind = 'spell', false) and not {HAS.format('spell-utility')})) anti_air,
    count(*) filter (kind = 'building') buildings, count(*) filter ({HAS.format('splash-damage')}) splash, count(*) filter ({HAS.format('tank-killer')}) tank_killers,
    count(*) filter (elixir > 0 and elixir <= 3) cheap_cards, cast(coalesce(min(case when elixir > 0 then elixir end), 0) as bigint) cheapest, coalesce(avg(case when elixir > 0 then elixir end), 0) average_elixir,
    len(list_distinct(flatten(list(roles)))) distinct_roles, count(*) filter (card is null) unknown_cards
    from fe left join cat on fe.c = cat.card group by 1)"""


@register("composition_features", f"{DECKS_SQL}, {FEATURES_SQL} select * replace (round(average_elixir, 6) as average_elixir) from ft")
def composition_features(spark, sf_dir):
    return rounded(composition.features(decks_of(spark, sf_dir), catalogue_of(spark, sf_dir), ("deck_key", "plays")), "average_elixir")


@register("composition_rules", f"{DECKS_SQL}, {FEATURES_SQL} " + " union all ".join(f"select '{n}' as rule, round(avg(({t.replace('D', '')})::int), 6) deck_pass_rate, round(sum(case when {t.replace('D', '')} then plays else 0 end)::double / sum(plays), 6) play_pass_rate from ft" for n, t in composition.RULES.items()))
def composition_rules(spark, sf_dir):
    return rounded(composition.rule_rates(composition.features(decks_of(spark, sf_dir), catalogue_of(spark, sf_dir), ("deck_key", "plays"))), "deck_pass_rate", "play_pass_rate")


@register("composition_admission", f"{DECKS_SQL}, {FEATURES_SQL} select deck_key, unknown_cards > 0 or (anti_air >= 2 and average_elixir <= 5 and buildings <= 2 and distinct_roles >= 8) wide, unknown_cards > 0 or (anti_air >= 2 and average_elixir <= 5 and buildings <= 2 and distinct_roles >= 8 and cheap_cards >= 2 and any_spells >= 1) tight from ft")
def composition_admission(spark, sf_dir):
    f = composition.features(decks_of(spark, sf_dir), catalogue_of(spark, sf_dir))
    return f.select("deck_key", composition.admitted(composition.WIDE).alias("wide"), composition.admitted(composition.TIGHT).alias("tight"))


PROFILE_ROLES, PROFILE_KINDS = ("anti-air", "win-condition"), ("building", "spell", "troop")
ELIXIR = "case when elixir > 0 then elixir::double end"


@register("role_profile", f"{DECKS_SQL}, {CATALOGUE_SQL}, fe as (select deck_key, unnest(cards) c from decks) select deck_key, " + ", ".join(f"count(*) filter ({HAS.format(r)}) \"role:{r}\"" for r in PROFILE_ROLES) + ", " + ", ".join(f"count(*) filter (kind = '{k}') \"kind:{k}\"" for k in PROFILE_KINDS) + f", count(*) filter (contains(lower(targets), 'air')) hits_air, count(*) filter (lower(transport) = 'air') air_unit, round(coalesce(avg({ELIXIR}), 0), 6) elixir_mean, round(coalesce(stddev_pop({ELIXIR}), 0), 6) elixir_std, " + ", ".join(f"count(*) filter ({ELIXIR} between {a} and {b}) \"elixir:{a}-{b}\"" for a, b in ((0, 2), (3, 3), (4, 4), (5, 5), (6, 99))) + " from fe left join cat on fe.c = cat.card group by 1")
def role_profile(spark, sf_dir):
    out = composition.profile(decks_of(spark, sf_dir), catalogue_of(spark, sf_dir), PROFILE_ROLES, PROFILE_KINDS)
    return rounded(out, "elixir_mean", "elixir_std")


@register("knn_novelty", "with e as (select vec_id id, embedding::double[] v from embeddings), d as (select q.id, list_distance(q.v, r.v) d from e q join e r on q.id <> r.id), k as (select *, row_number() over (partition by id order by d) n from d) select id, round(avg(d), 5) distance from k where n <= 25 group by 1")
def knn_novelty(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return composition.nearest(e, e, 25).withColumn("distance", F.round("distance", 5))


@register("card_names", "with n as (select l_orderkey, l_linenumber, '  ' || upper(p_name) || case when l_linenumber = 7 then ' ?' else ' ' end as name from lineitem join part on l_partkey = p_partkey), c as (select replace(lower(trim(p_name)), ' ', '-') slug, min(p_partkey) card from part group by 1) select l_orderkey, l_linenumber, slug, card from (select *, replace(lower(trim(name)), ' ', '-') slug from n) left join c using (slug)")
def card_names(spark, sf_dir):
    """Names as somebody writes them, and the cards that they mean."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("card"), F.col("p_name").alias("name"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    written = F.concat(F.lit("  "), F.upper("name"), F.when(F.col("l_linenumber") == 7, " ?").otherwise(" "))
    names = lines.join(part, F.col("l_partkey") == F.col("card")).select("l_orderkey", "l_linenumber", written.alias("name"))
    return composition.resolve(names, part).drop("name")


# Neighbours and selection ----------------------------------------------------------------------------

SEG_DECKS_SQL = f"with {battles_sql(GROWING)}, ds as (select segment, team_deck_key deck_key, team_card_ids cards, win won from battles union all select segment, opponent_deck_key, opponent_card_ids, not win from battles), sd as (select segment, deck_key, any_value(cards) cards, count(*) plays, cast(sum(won::int) as bigint) wins from ds group by all having count(*) >= 2)"
NEAR_SQL = "nr as (select a.segment, a.deck_key deck, b.deck_key neighbour, cast(greatest(len(a.cards), len(b.cards)) - len(list_intersect(a.cards, b.cards)) as int) changes from sd a join sd b on a.segment = b.segment and a.deck_key <> b.deck_key where greatest(len(a.cards), len(b.cards)) - len(list_intersect(a.cards, b.cards)) <= 2)"


def segment_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sides(derived_battles(spark, sf_dir, card_universe(spark, sf_dir)))
    return s.groupBy("segment", "deck_key").agg(F.first("cards").alias("cards"), F.count(F.lit(1)).alias("plays"), F.count_if("won").alias("wins")).where("plays >= 2")


@register("near_decks", f"{SEG_DECKS_SQL}, {NEAR_SQL} select * from nr")
def near_decks(spark, sf_dir):
    return neighbours.near_decks(segment_decks(spark, sf_dir), 2)


@register("most_played_neighbours", f"{SEG_DECKS_SQL}, {NEAR_SQL}, ml as (select nr.*, plays, row_number() over (partition by nr.segment, nr.deck order by plays desc, nr.neighbour) place from nr join sd on nr.segment = sd.segment and nr.neighbour = sd.deck_key) select *  from ml where place <= 20")
def most_played_neighbours(spark, sf_dir):
    return neighbours.most_played_near(segment_decks(spark, sf_dir), 2, 20)


@register("neighbour_feasibility", f"{SEG_DECKS_SQL}, {NEAR_SQL}, c as (select s.segment, k.k changes, s.deck_key, count(n.deck) n from sd s cross join (select unnest([1, 2]) k) k left join (select nr.* from nr join sd w on nr.segment = w.segment and nr.neighbour = w.deck_key where w.plays >= 3) n on n.segment = s.segment and n.deck = s.deck_key and n.changes <= k.k group by all) select segment, cast(changes as int) changes, count(*) seeds, round(quantile_cont(n, 0.5), 6) median, round(quantile_cont(n, 0.1), 6) p10, round(quantile_cont(n, 0.9), 6) p90, round(avg((n = 0)::int), 6) share_none from c group by all")
def neighbour_feasibility(spark, sf_dir):
    return rounded(neighbours.feasibility(segment_decks(spark, sf_dir), 2, 3), "median", "p10", "p90", "share_none")


@register("search_pools", f"{SEG_DECKS_SQL}, {NEAR_SQL} select nr.segment, deck pool_id, neighbour candidate from nr join sd on nr.segment = sd.segment and nr.deck = sd.deck_key and sd.plays >= 4 union all select segment, deck_key, deck_key from sd where plays >= 4")
def search_pools(spark, sf_dir):
    d = segment_decks(spark, sf_dir)
    return neighbours.pools(d, d.where("plays >= 4"), 2)


@register("locked_search", f"{SEG_DECKS_SQL} select segment, deck_key from sd where list_has_all(cards, [1]) and not list_has_any(cards, [7, 9])")
def locked_search(spark, sf_dir):
    return neighbours.containing(segment_decks(spark, sf_dir), F.array(F.lit(1)), F.array(F.lit(7), F.lit(9))).select("segment", "deck_key")


CAND_SQL = f"{PLAYS_SQL}, ca as (select segment, deck_key, plays train_n, wins::double / plays score, (wins + 10.0::double) / (plays + 20) quality, case when plays >= 60 then 0.05::double else 0.12::double end sigma from plays)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plays_of(spark, sf_dir)
    return p.select("segment", "deck_key", F.col("plays").alias("train_n"), (F.col("wins") / F.col("plays")).alias("score"), ((F.col("wins") + 10.0) / (F.col("plays") + 20)).alias("quality"), F.when(F.col("plays") >= 60, 0.05).otherwise(0.12).alias("sigma"))


SELECT_SQL = f"{CAND_SQL}, sl as (select * from (select k.k::double k, ca.*, row_number() over (partition by k.k, segment order by score - k.k * sigma desc, score desc, train_n desc, deck_key desc) r from ca, (select unnest([0.0, 0.5, 1.0, 2.0]) k) k) where r = 1)"


@register("penalised_selection", f"{SELECT_SQL} select k, segment, deck_key, train_n, round(score, 6) score, round(quality, 6) quality from sl")
def penalised_selection(spark, sf_dir):
    out = neighbours.select_by_penalty(candidates(spark, sf_dir), (0.0, 0.5, 1.0, 2.0), ["segment"])
    return rounded(out.drop("sigma"), "score", "quality")


@register("macro_selection", f"{SELECT_SQL} select k, count(*) cells, round(avg(quality), 6) macro_mean, 1.0::double median_pools from sl group by 1")
def macro_selection(spark, sf_dir):
    out = neighbours.select_by_penalty(candidates(spark, sf_dir), (0.0, 0.5, 1.0, 2.0), ["segment"])
    return rounded(neighbours.macro_mean(out, ["segment"], "quality"), "macro_mean")


RULES = {"unrestricted": "true", "train support >= 30": "train_n >= 30", "train support >= 60": "train_n >= 60", "train support >= 10000": "train_n >= 10000"}
ADMIT_SQL = f"{CAND_SQL}, fr as (select * from (select *, row_number() over (partition by segment order by score desc, train_n desc, deck_key desc) r from ca) where r = 1), rw as (" + " union all ".join(f"select * from (select '{n}' as rule, *, row_number() over (partition by segment order by score desc, train_n desc, deck_key desc) r from ca where {t}) where r = 1" for n, t in RULES.items()) + "), al as (select ru.rule, fr.segment, fr.deck_key fk, fr.quality fq, rw.deck_key is null emp, coalesce(rw.deck_key, fr.deck_key) k, coalesce(rw.quality, fr.quality) q, coalesce(rw.train_n, fr.train_n) t from fr cross join (select unnest([" + ", ".join(f"'{n}'" for n in RULES) + "]) as rule) ru left join rw on rw.rule = ru.rule and rw.segment = fr.segment)"


@register("admission_rules", f"{ADMIT_SQL} select rule, count(*) searches, round(avg((k <> fk)::int), 6) changed_selection_share, round(avg(emp::int), 6) empty_pool_share, round(avg(q), 6) mean_test_quality, round(avg(q - fq), 6) delta_vs_unrestricted, round(quantile_cont(t, 0.5), 6) median_selected_support, round(avg((t = 0)::int), 6) zero_support_selection_share from al group by 1")
def admission_rules(spark, sf_dir):
    out = neighbours.admission(candidates(spark, sf_dir), RULES, ["segment"])
    return rounded(out, *[c for c in out.columns if c not in ("rule", "searches")])


POISSON = " + ".join(f"(u >= {c!r}::double)::int" for c in neighbours.POISSON_ONE)


@register("admission_intervals", f"{ADMIT_SQL}, dt as (select rule, segment, q - fq d from al), sm as (select *, {POISSON} copies from (select dt.*, s, cast(('0x' || substr(md5('7:' || s || ':' || segment), 1, 12)) as bigint)::double / 281474976710656::double u from dt, range(1, 201) t(s))), mn as (select rule, s, sum(copies * d) / nullif(sum(copies), 0) m from sm group by all) select rule, round(any_value(x.delta), 6) delta, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high, count(m) samples from mn join (select rule, avg(d) delta from dt group by 1) x using (rule) group by 1")
def admission_intervals(spark, sf_dir):
    return rounded(neighbours.admission_intervals(candidates(spark, sf_dir), RULES, ["segment"]), "delta", "low", "high")


CURSE_SQL = f"{CAND_SQL}, rk as (select *, row_number() over (partition by segment order by score desc, deck_key) r, count(*) over (partition by segment) n from ca), pb as (select rk.*, s.s, exp(lgamma(n - r + 1) - lgamma(s.s) - lgamma(n - r - s.s + 2) - lgamma(n + 1) + lgamma(s.s + 1) + lgamma(n - s.s + 1)) p from rk, (select unnest([1, 2, 5, 10, 30]) s) s where s.s <= n and n - r >= s.s - 1)"


@register("selection_curse", f"{CURSE_SQL} select segment, cast(s as int) as size, round(sum(p * score), 6) promised, round(sum(p * quality), 6) observed, round(sum(p), 6) mass from pb group by all")
def selection_curse(spark, sf_dir):
    return rounded(neighbours.selection_curse(candidates(spark, sf_dir), (1, 2, 5, 10, 30), truth="quality"), "promised", "observed", "mass")


@register("stratified_sample", f"{BASE} select game_id, segment from (select *, row_number() over (partition by segment order by md5(game_id::varchar), game_id) r from battles) where r <= 200")
def stratified_sample(spark, sf_dir):
    return neighbours.strata(derived_battles(spark, sf_dir), "segment", "game_id", 200).select("game_id", "segment")


@register("heldout_residuals", f"{P_SQL}, s as (select * from (select *, row_number() over (partition by segment order by md5(game_id::varchar), game_id) r from p) where r <= 500), b as (select segment, team_deck_key deck_key, 'team' side, target::int - probability residual from s union all select segment, opponent_deck_key, 'opponent', probability - target::int from s) select segment, deck_key, side, count(*) n, round(sum(residual), 6) residual from b group by all")
def heldout_residuals(spark, sf_dir):
    s = neighbours.strata(predicted(spark, sf_dir), "segment", "game_id", 500)
    off = F.col("target").cast("int") - F.col("probability")
    both = F.explode(F.array(F.struct(F.col("team_deck_key").alias("deck_key"), F.lit("team").alias("side"), off.alias("r")), F.struct(F.col("opponent_deck_key").alias("deck_key"), F.lit("opponent").alias("side"), (-off).alias("r"))))
    return rounded(s.select("segment", both.alias("b")).groupBy("segment", "b.deck_key", "b.side").agg(F.count(F.lit(1)).alias("n"), F.sum("b.r").alias("residual")), "residual")


SCORED = "0.5::double + 0.03::double * (len(string_split(deck_key, ',')) - len(string_split(o_key, ',')))"
PANEL_SQL = f"{PLAYS_SQL}, panel as (select segment, deck_key o_key, plays::double / sum(plays) over (partition by segment) weight from (select *, row_number() over (partition by segment order by plays desc, deck_key) r from plays) where r <= 15), mt as (select p.segment, p.deck_key, weight w, {SCORED} s from plays p join panel using (segment)), ps as (select segment, deck_key, sum(w * s) score, sum(w * s * s) m2, sum(case when s <= 0.45 then w else 0 end) unfavorable_share, sum(case when s <= 0.35 then w else 0 end) hard_counter_share, sum(case when s >= 0.55 then w else 0 end) favorable_share, min(s) worst_matchup from mt group by all)"


def panel_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = plays_of(spark, sf_dir)
    panel = deck_stats.panel(plays, 15).select("segment", F.col("deck_key").alias("o_key"), "weight")
    score = F.lit(0.5) + F.lit(0.03) * (F.size(F.split("deck_key", ",")) - F.size(F.split("o_key", ",")))
    return neighbours.panel_scores(plays, panel, score)


@register("panel_scores", f"{PANEL_SQL} select segment, deck_key, round(score, 6) score, round(sqrt(greatest(m2 - score * score, 0)), 4) matchup_sigma, round(unfavorable_share, 6) unfavorable_share, round(hard_counter_share, 6) hard_counter_share, round(favorable_share, 6) favorable_share, round(worst_matchup, 6) worst_matchup from ps")
def panel_scores(spark, sf_dir):
    out = rounded(panel_scored(spark, sf_dir), "score", "unfavorable_share", "hard_counter_share", "favorable_share", "worst_matchup")
    return out.withColumn("matchup_sigma", F.round("matchup_sigma", 4))


@register("display_calibration", f"{CAND_SQL}, r as (select segment, score x, (score + 0.5) / 2 y, quality t from ca), l as (select segment, avg(x) mx, avg(y) my, coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 1) sl, count(*) n from r group by 1) select l.segment, round(mx, 6) mean_score, round(my, 6) mean_rate, round(sl, 6) slope, l.n, round(avg(abs(x - t)), 6) raw_mae, round(avg(abs(my + sl * (x - mx) - t)), 6) linear_mae, round(avg(x - t), 6) raw_bias, round(avg(my + sl * (x - mx) - t), 6) linear_bias from r join l using (segment) group by all")
def display_calibration(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("rate", (F.col("score") + 0.5) / 2)
    out = neighbours.line_fit(c, "score", "rate", "quality", ["segment"])
    return rounded(out, *[x for x in out.columns if x not in ("segment", "n")])


MEMBERS_SQL = f"{P_SQL}, mb as (select game_id, m.m, probability + 0.01::double * m.m * (game_id % 7) / 7 q, abs(target::int - probability) err from p, (select unnest([0, 1, 2]) m) m), en as (select game_id, avg(q) mean, stddev_samp(q) spread, count(distinct m) members, max(err) error from mb group by 1)"


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir)
    m = p.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("game_id", "m", (F.col("probability") + F.lit(0.01) * F.col("m") * (F.col("game_id") % 7) / 7).alias("q"), F.abs(F.col("target").cast("int") - F.col("probability")).alias("err"))
    return neighbours.spread(m, ["game_id"], "m", "q", "err")


@register("ensemble_spread", f"{MEMBERS_SQL} select game_id, round(mean, 6) mean, round(spread, 6) spread, members, round(error, 6) error from en")
def ensemble_spread(spark, sf_dir):
    return rounded(ensemble(spark, sf_dir), "mean", "spread", "error")


@register("spread_error_correlation", f"{MEMBERS_SQL} select round(corr(spread, error), 6) r, count(*) n from en where isfinite(spread) and isfinite(error)")
def spread_error_correlation(spark, sf_dir):
    e = ensemble(spark, sf_dir).where(~F.isnan("spread") & ~F.isnan("error"))
    return rounded(e.agg(F.corr("spread", "error").alias("r"), F.count(F.lit(1)).alias("n")), "r")


@register("spread_quintiles", f"{P_SQL}, v as (select probability v, target::int m from p), e as (select quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) e from v) select cast((v >= e[1])::int + (v >= e[2])::int + (v >= e[3])::int + (v >= e[4])::int as int) part, count(*) as rows, round(avg(v), 6) mean_value, round(avg(m), 6) mean_measure from v, e group by 1")
def spread_quintiles(spark, sf_dir):
    p = predicted(spark, sf_dir).select(F.col("probability").alias("v"), F.col("target").cast("int").alias("m"))
    return rounded(neighbours.quantile_table(p, "v", "m"), "mean_value", "mean_measure")


@register("hero_evo_interactions")
def hero_evo_interactions(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("hero", F.expr("game_id % 4 = 1")).withColumn("evo", F.expr("game_id % 3 = 0"))
    return rounded(correction.interactions(p, ["segment"]), "p11", "p01", "p10", "p00", "interaction")


H11, H01, H10, H00 = (f"avg(probability) filter ({h} and {e})" for h, e in (("game_id % 4 = 1", "game_id % 3 = 0"), ("game_id % 4 <> 1", "game_id % 3 = 0"), ("game_id % 4 = 1", "game_id % 3 <> 0"), ("game_id % 4 <> 1", "game_id % 3 <> 0")))
ORACLE["hero_evo_interactions"] = f"{P_SQL} select segment, round({H11}, 6) p11, round({H01}, 6) p01, round({H10}, 6) p10, round({H00}, 6) p00, round(({H11} - {H01}) - ({H10} - {H00}), 6) interaction from p group by 1"

COEFFICIENTS = {1: 0.2, 3: -0.1, 4: 0.05}


@register("hero_adjustment", f"{BASE}, s as (select game_id, s.side, list_zip(s.cards, list_transform(s.cards, lambda c: (game_id + c) % 4)) z from battles, (select unnest(['team', 'opponent']) side) x, lateral (select x.side, case when x.side = 'team' then team_card_ids else opponent_card_ids end cards) s), t as (select game_id, side, case when len(list_filter(z, lambda x: x[2] & 1 > 0)) > 0 then list_sum(list_transform(list_filter(z, lambda x: x[2] & 2 > 0), lambda x: case x[1] when 1 then 0.2::double when 3 then -0.1::double when 4 then 0.05::double else 0 end)) else 0 end v from s) select game_id, round(0.75 * (sum(case when side = 'team' then coalesce(v, 0) else 0 end) - sum(case when side = 'opponent' then coalesce(v, 0) else 0 end)), 6) adjustment from t group by 1")
def hero_adjustment(spark, sf_dir):
    b = derived_battles(spark, sf_dir)
    for side in ("team", "opponent"):
        b = b.withColumn(f"{side}_evolution_levels", F.transform(f"{side}_card_ids", lambda c: ((F.col("game_id") + c) % 4).cast("int"))).withColumn(f"{side}_hero_levels", F.transform(f"{side}_card_ids", lambda c: F.lit(0)))
    return rounded(b.select("game_id", correction.hero_adjustment(COEFFICIENTS).alias("adjustment")), "adjustment")


# Priors ----------------------------------------------------------------------------------------------


def keyed(battles: DataFrame) -> DataFrame:
    arch = lambda c: F.concat(F.lit("a"), F.array_min(c).cast("string"))
    plan = lambda c: F.concat(F.lit("p"), F.size(c).cast("string"))
    spells = lambda c: F.concat(F.lit("s"), F.size(F.filter(c, lambda x: x % 2 == 0)).cast("string"))
    return prior.keys(battles, arch, plan, spells, F.col("segment"))


PRIOR_SQL = f"""{BASE}, {SPLIT_SQL}, sd as (select game_id, segment, split, true own, win won, team_card_ids a, opponent_card_ids b from split union all select game_id, segment, split, false, not win, opponent_card_ids, team_card_ids from split),
    nm as (select *, 'a' || list_min(a) || '>a' || list_min(b) arch, 'p' || len(a) || '>p' || len(b) plan, 's' || len(list_filter(a, lambda x: x % 2 = 0)) || '>a' || list_min(b) answer from sd),
    ky as (select game_id, split, own, won, unnest(['archGlobal', 'archBucket', 'planGlobal', 'planBucket', 'spellAnswerGlobal']) as level, unnest([arch, segment || '#' || arch, plan, segment || '#' || plan, answer]) as key from nm),
    mx as (select level, key, count(*) n, (count(*) filter (won) - count(*) / 2.0::double) / (count(*) + 20.0::double) delta, count(*) / (count(*) + 20.0::double) weight from ky where split = 'train' group by all)"""


@register("prior_matrix", f"{PRIOR_SQL} select level, key, n, round(delta, 6) delta, round(weight, 6) weight from mx")
def prior_matrix(spark, sf_dir):
    train = split_battles(spark, sf_dir).where("split = 'train'").drop("split")
    return rounded(prior.matrix(keyed(train), keyed(swapped(train))), "delta", "weight")


@register("largest_priors", f"{PRIOR_SQL} select level, key, round(delta, 6) delta from mx order by round(abs(delta), 9) desc, level, key limit 15")
def largest_priors(spark, sf_dir):
    train = split_battles(spark, sf_dir).where("split = 'train'").drop("split")
    return rounded(deck_stats.largest(prior.matrix(keyed(train), keyed(swapped(train))), "delta", 15, "level", "key").select("level", "key", "delta"), "delta")


def with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = split_battles(spark, sf_dir)
    train = b.where("split = 'train'").drop("split")
    return prior.attach(keyed(b.where("split = 'test'")), prior.matrix(keyed(train), keyed(swapped(train))))


@register("empirical_prior", f"{PRIOR_SQL} select game_id, round(least(greatest(0.5 + coalesce(sum(weight * delta) / nullif(sum(weight), 0), 0), 0.001), 0.999), 6) matrix_prior from ky left join mx using (level, key) where split = 'test' and own group by 1")
def empirical_prior(spark, sf_dir):
    return rounded(with_prior(spark, sf_dir).select("game_id", "matrix_prior"), "matrix_prior")


@register("prior_coverage", f"{PRIOR_SQL} select count(distinct game_id) as rows, " + ", ".join(f"round(avg((mx.key is not null)::int) filter (level = '{n}'), 6) \"{n}\"" for n in prior.LEVELS) + " from ky left join mx using (level, key) where split = 'test' and own")
def prior_coverage(spark, sf_dir):
    return rounded(prior.coverage(with_prior(spark, sf_dir)), *prior.LEVELS)
