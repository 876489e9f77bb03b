"""Binary metrics, calibration, noise floors and reports, over (target, probability) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltyard.functions.labels import meta



def clipped(p: Column, by: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(by)), F.lit(1 - by))


def auc(df: DataFrame, by: Sequence[str] = (), target: str = "target", probability: str = "probability") -> DataFrame:
    """The probability that a positive outranks a negative, ties as halves; null with one class.

    Counts by distinct probability come first, so the running sums are over as many rows as there are
    different probabilities.
    """
    y = F.col(target).cast("int")
    counts = df.groupBy(*by, clipped(F.col(probability)).alias("_p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    if by:
        below = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    else:
        counts = running(counts, ["_p"], "neg", "_below").drop("_total")
    won = F.col("pos") * (F.col("_below") + F.col("neg") / F.lit(2.0))
    return counts.withColumn("won", won).groupBy(*by).agg((F.sum("won") / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def _losses(target: str, probability: str, by: float = 1e-6) -> dict[str, Column]:
    y, p = F.col(target).cast("double"), clipped(F.col(probability), by)
    return {
        "accuracy": F.avg(((p >= 0.5) == (y == 1.0)).cast("double")),
        "log_loss": F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))),
        "brier_score": F.avg((p - y) * (p - y)),
    }


def scalar_metrics(df: DataFrame, by: Sequence[str] = (), target: str = "target", probability: str = "probability") -> DataFrame:
    """Rows, accuracy at 0.5, AUC, log-loss and Brier score, a group a row."""
    losses = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in _losses(target, probability).items()])
    ranks = auc(df, by, target, probability)
    if not by:
        return losses.crossJoin(F.broadcast(ranks))
    renamed = ranks.select(*[F.col(b).alias(f"_{b}") for b in by], "auc")
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return losses.join(renamed, same, "left").drop(*[f"_{b}" for b in by])


def fixed_calibration(df: DataFrame, bins: int = 10, target: str = "target", probability: str = "probability") -> DataFrame:
    """Bins of equal width, the last one closed; edges are those of i / bins, empty bins have no row."""
    p = F.col(probability)
    guess = F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))
    # the product may round to the other side of an edge
    which = F.when((guess < bins - 1) & (p >= (guess + 1) / F.lit(float(bins))), guess + 1).when(p < guess / F.lit(float(bins)), guess - 1).otherwise(guess)
    out = df.where(p.between(0, 1)).groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_prediction"), F.avg(F.col(target).cast("double")).alias("observed_rate"))
    return out.withColumn("lower", F.col("bin") / F.lit(float(bins))).withColumn("upper", (F.col("bin") + 1) / F.lit(float(bins))).withColumn("absolute_error", F.abs(F.col("mean_prediction") - F.col("observed_rate")))


def quantile_calibration(df: DataFrame, row_id: str, bins: int = 15, target: str = "target", probability: str = "probability") -> DataFrame:
    """Bins of equal counts by rank; the row id decides ties.

    Ranks come from sorted cells with their counts, so that no one task sorts all the rows.
    """
    placed = ranked(df.select(F.col(probability).alias("p"), F.col(target).cast("double").alias("y"), F.col(row_id).alias("id")), ["p", "id"])
    n, k = F.col("n"), F.least(F.lit(bins), F.col("n"))
    long, size = n % k, F.floor(n / k)
    at = F.col("rank") - 1
    which = F.when(at < long * (size + 1), F.floor(at / (size + 1))).otherwise(long + F.floor((at - long * (size + 1)) / F.greatest(size, F.lit(1))))
    out = placed.withColumn("bin", (which + 1).cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_prediction"), F.avg("y").alias("observed_rate"))
    return out.withColumn("absolute_error", F.abs(F.col("mean_prediction") - F.col("observed_rate")))


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """With each row's ``rank`` from 1 in a total order and ``n``, all rows."""
    out = running(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_before")
    return out.withColumn("rank", F.col("_before") + 1).withColumn("n", F.col("_total")).drop("_one", "_before", "_total")


def _place(row: tuple) -> list:
    """Spark's order of a key: nulls, numbers and texts, not-a-number."""
    return [(0, 0) if x is None else (2, 0) if x != x else (1, x) for x in row]


def running(df: DataFrame, order: Sequence[str], weight: str, name: str, cells: int = 1024, sampled: int = 8192) -> DataFrame:
    """With ``name``, the weight of all rows before this one in a total order, and ``_total``, that of all.

    Rows go to cells between keys of a sample, those of least hash, in the full order; so cells hold about as many
    rows each, however crowded one column is, as rows differ somewhere in it. Sums run within cells, over the cells
    before.
    """
    some = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(sampled)
    keys = sorted({tuple(r) for r in some.collect()}, key=_place)
    kind = ", ".join(f"k{i}: {df.schema[c].dataType.simpleString()}" for i, c in enumerate(order))
    cuts = [keys[i * len(keys) // cells] for i in range(1, cells) if i * len(keys) // cells > (i - 1) * len(keys) // cells]
    step = max(1, math.isqrt(len(cuts)))
    nested = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = df.sparkSession.createDataFrame([([c[0] for c in nested], nested)], f"_heads array<struct<{kind}>>, _cuts array<array<struct<{kind}>>>")
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    head = F.size(F.filter("_heads", lambda x: x <= key))
    fine = F.size(F.filter(F.coalesce(F.get("_cuts", head - 1), F.array().cast(f"array<struct<{kind}>>")), lambda x: x <= key))
    celled = df.crossJoin(F.broadcast(table)).withColumn("_cell", head * (step + 1) + fine).drop("_heads", "_cuts")
    sums = celled.groupBy("_cell").agg(F.sum(weight).alias("_w"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a cell
    sums = sums.select(F.col("_cell").alias("_of_cell"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_to"), F.sum("_w").over(Window.partitionBy()).alias("_total"))
    within = F.sum(weight).over(Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return celled.join(F.broadcast(sums), F.col("_cell") == F.col("_of_cell")).withColumn(name, F.col("_to") + F.coalesce(within, F.lit(0))).drop("_cell", "_of_cell", "_to")


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, value.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))


def exact_percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """A row a group: exact percentiles with linear interpolation, from counts of distinct values and running sums,
    so that no task has all of a group's values."""
    return percentiles_of(value_counts(df, value, by), shares, by)


def percentiles_of(counts: DataFrame, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    at = running(counts, [*by, "_v"], "_c", "_before").drop("_total")
    first = at.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_n"))
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    at = at.join(first, same) if by else at.crossJoin(F.broadcast(first))
    below = F.col("_before") - F.col("_first")

    def pick(share: float) -> Column:
        position = (F.col("_n") - 1) * F.lit(float(share))
        here = lambda k: F.max(F.when((below <= k) & (k < below + F.col("_c")), F.col("_v")))
        low, high = here(F.floor(position)), here(F.ceil(position))
        up, down = F.max(F.ceil(position) - position), F.max(position - F.floor(position))
        return F.when(low == high, low).otherwise(up * low + down * high)

    return at.groupBy(*by).agg(*[pick(s).alias(n) for n, s in shares.items()])


def expected_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a calibration table."""
    return table.agg(F.coalesce(F.sum(F.col("count") * F.col("absolute_error")) / F.sum("count"), F.lit(0.0)).alias("ece"))


def calibration_line(df: DataFrame, target: str = "target", probability: str = "probability", steps: int = 50) -> tuple[float | None, float | None]:
    """Slope and intercept of the logistic regression of the target on logit(p); None with one class.

    Newton's method on two numbers: a step is one pass of sums. Equal probabilities are summed first.
    """
    p = clipped(F.col(probability))
    rows = df.groupBy(F.ln(p / (1 - p)).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("y")).cache()
    try:
        n, y = rows.agg(F.sum("n"), F.sum("y")).first()
        if not n or y in (0, n):
            return None, None
        slope, intercept = 1.0, 0.0
        for _ in range(steps):
            q = 1 / (1 + F.exp(-(F.lit(slope) * F.col("x") + F.lit(intercept))))
            w = F.col("n") * q * (1 - q)
            g = rows.select((F.col("y") - F.col("n") * q).alias("r"), w.alias("w"), "x")
            r0, r1, a, b, c = g.agg(F.sum("r"), F.sum(F.col("r") * F.col("x")), F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("x") * F.col("x"))).first()
            det = a * c - b * b
            if abs(det) < 1e-12:
                break
            d_int, d_slope = (c * r0 - b * r1) / det, (a * r1 - b * r0) / det
            slope, intercept = slope + d_slope, intercept + d_int
            if math.hypot(d_int, d_slope) < 1e-10:
                break
        return slope, intercept
    finally:
        rows.unpersist()


def bootstrap(df: DataFrame, row_id: str, samples: int = 200, seed: int = 7, target: str = "target", probability: str = "probability", cluster: Sequence[str] | None = None) -> DataFrame:
    """Percentile intervals of Brier score, log-loss and accuracy: metric, low, high, std.

    Poisson bootstrap: a row (or a cluster of rows) counts in each sample as often as a Poisson(1) draw from
    a hash of its id says, so samples need no draws from all rows and one pass sums them all.
    """
    y, p = F.col(target).cast("double"), clipped(F.col(probability))
    unit = F.concat_ws("|", *[F.col(c).cast("string") for c in (cluster or [row_id])])
    losses = df.select(unit.alias("unit"), ((p - y) * (p - y)).alias("brier_score"), (-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), ((p >= 0.5) == (y == 1)).cast("double").alias("accuracy"))
    sums = losses.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in ("brier_score", "log_loss", "accuracy")])
    draws = sums.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("w", poisson_one(F.col("unit"), F.col("sample"), seed))
    each = draws.groupBy("sample").agg(*[(F.sum(F.col("w") * F.col(m)) / F.nullif(F.sum(F.col("w") * F.col("n")).cast("double"), F.lit(0.0))).alias(m) for m in ("brier_score", "log_loss", "accuracy")])
    long = each.unpivot(["sample"], ["brier_score", "log_loss", "accuracy"], "metric", "value")
    return long.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.stddev_samp("value").alias("std"))


def poisson_one(unit: Column, sample: Column, seed: int) -> Column:
    """A Poisson draw of mean one from a hash."""
    u = F.shiftrightunsigned(F.xxhash64(unit, sample, F.lit(seed)), 11) / F.lit(float(1 << 53))
    total, term, out = 0.0, math.exp(-1), F.lit(12)
    limits = []
    for k in range(12):
        total += term
        limits.append((k, total))
        term /= k + 1
    for k, limit in reversed(limits):
        out = F.when(u < limit, k).otherwise(out)
    return out


def noise_floor(df: DataFrame, key: str, least: int, target: str = "target") -> DataFrame:
    """One row: the Brier score that no model of matchups can beat, over matchups of at least ``least`` rows.

    Rates come from one aggregate a matchup, and all that is asked of rows follows from its counts, so
    nothing is joined back.
    """
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("p"))
    ok = F.col("n") >= least
    rows = F.sum(F.when(ok, F.col("n")))
    q = clipped(F.col("p"))
    entropy = -(F.col("p") * F.ln(q) + (1 - F.col("p")) * F.ln(1 - q))
    right = F.greatest(F.col("p"), 1 - F.col("p"))
    return per.agg(
        F.lit(least).alias("min_support"), F.count(F.lit(1)).alias("observed_matchups"), F.count_if(ok).alias("supported_matchups"), F.coalesce(rows, F.lit(0)).alias("supported_rows"),
        F.coalesce(rows / F.nullif(F.sum("n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("coverage"),
        (F.sum(F.when(ok, F.col("n") * F.col("p") * (1 - F.col("p")))) / rows).alias("irreducible_brier"),
        (F.sum(F.when(ok, F.col("n") * entropy)) / rows).alias("oracle_log_loss"),
        (F.sum(F.when(ok, F.col("n") * right)) / rows).alias("oracle_accuracy"),
    )


def benchmark(df: DataFrame, key: str, models: Sequence[str], least: int, target: str = "target") -> DataFrame:
    """A row a probability column: metrics on all rows, and Brier score, gap to the noise floor and share of the
    first column's headroom on rows of supported matchups."""
    y = F.col(target).cast("double")
    rates = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_rate")).where(F.col("_n") >= least)
    joined = df.join(rates, F.col(key) == F.col("_k"), "left")
    long = joined.select(y.alias("target"), "_rate", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("probability")) for m in models])).alias("m")).select("target", "_rate", "m.*")
    ok = F.col("_rate").isNotNull()
    loss = (clipped(F.col("probability")) - F.col("target")) * (clipped(F.col("probability")) - F.col("target"))
    floor = long.groupBy(F.col("model").alias("f_model")).agg(F.avg(F.when(ok, loss)).alias("supported_brier"), F.avg(F.when(ok, F.col("_rate") * (1 - F.col("_rate")))).alias("irreducible_brier"))
    out = scalar_metrics(long, ["model"]).join(floor, F.col("model") == F.col("f_model")).drop("f_model").withColumn("gap_to_floor", F.col("supported_brier") - F.col("irreducible_brier"))
    base = F.max(F.when(F.col("model") == models[0], F.col("supported_brier"))).over(Window.partitionBy())
    room = base - F.col("irreducible_brier")
    return out.withColumn("headroom_captured", F.when(room > 0, (base - F.col("supported_brier")) / room))


def meta_report(df: DataFrame, least: int, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """One row: how well classes and rates agree over oriented matchups of at least ``least`` games."""
    pairs = df.groupBy("segment", "team_deck_key", "opponent_deck_key").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("predicted"), F.avg(F.col("target").cast("int")).alias("observed"))
    ok = F.col("n") >= least
    n = F.when(ok, F.col("n"))
    off = F.abs(F.col("predicted") - F.col("observed"))
    agree = (meta(F.col("predicted"), low, high) == meta(F.col("observed"), low, high)).cast("int")
    part = lambda top: F.coalesce(F.sum(F.when(ok, top)) / F.nullif(F.sum(n).cast("double"), F.lit(0.0)), F.lit(0.0))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("test_games"), F.count(F.lit(1)).alias("observed_exact_matchups"), F.count_if(ok).alias("supported_matchups"), F.coalesce(F.sum(n), F.lit(0)).alias("supported_games"),
        F.coalesce(F.sum(n) / F.nullif(F.sum("n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("coverage"), part(F.col("n") * agree).alias("meta_weighted_class_accuracy"),
        F.coalesce(F.avg(F.when(ok, off)), F.lit(0.0)).alias("matchup_mae"), part(F.col("n") * off).alias("matchup_mae_weighted"),
    )


def class_distribution(df: DataFrame, low: float = 0.45, high: float = 0.55) -> DataFrame:
    out = df.groupBy(meta(F.col("probability"), low, high).alias("matchup_class")).agg(F.count(F.lit(1)).alias("games"))
    return out.withColumn("meta_share", F.col("games") / F.sum("games").over(Window.partitionBy()))


def compare_calibrations(df: DataFrame, variants: Sequence[str], by: str = "segment", target: str = "target") -> DataFrame:
    """Brier score, log-loss, means and bias of several probability columns, a group and column a row."""
    long = df.select(F.col(by), F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), clipped(F.col(v), 1e-7).alias("p")) for v in variants])).alias("v")).select(by, "y", "v.*")
    p, y = F.col("p"), F.col("y")
    return long.groupBy(by, "variant").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate"), F.avg(p - y).alias("bias"),
    )
