"""Telling two populations of decks apart, and signals beside a score."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tiltyard.operators.metrics import auc, exact_percentiles, poisson_one


@dataclass(frozen=True)
class Setup:
    """One way to tell populations apart: which real rows take part, the columns left out, and the ridge's
    strength (the penalty is the squared weights' half, over ``strength``)."""

    condition: str = "true"
    without: tuple[str, ...] = ()
    strength: float = 1.0


Weights = tuple[dict[str, float], float]  # of raw columns, and the intercept


def standard(df: DataFrame, columns: Sequence[str], label: str, setups: Sequence[Setup] = (Setup(),)) -> list[dict[str, tuple[float, float]]]:
    """Of each setup every feature's mean and deviation over its real population (label 0); a constant has
    deviation one."""
    wanted = []
    for k, setup in enumerate(setups):
        for i, c in enumerate(columns):
            own = F.when((F.col(label) == 0) & F.expr(setup.condition), F.col(f"`{c}`"))
            wanted += [F.avg(own).alias(f"m{k}_{i}"), F.stddev_pop(own).alias(f"s{k}_{i}")]
    row = df.agg(*wanted).first()
    return [{c: (row[f"m{k}_{i}"] or 0.0, row[f"s{k}_{i}"] or 1.0) for i, c in enumerate(columns)} for k in range(len(setups))]


def _newton(sums: Callable[[np.ndarray], np.ndarray], models: int, d: int, steps: int = 60) -> np.ndarray:
    """Many ridge regressions in step: ``sums`` gives, at some weights, each model's loss, gradient and curvature
    in one pass; a step that makes a loss greater is halved."""
    at = np.zeros((models, d))
    step, best, grad, curve = np.zeros_like(at), np.full(models, np.inf), None, None
    done = np.zeros(models, bool)
    for _ in range(steps):
        got = sums(at)
        worse = got[:, 0] > best + 1e-9 * np.abs(best) + 1e-12
        step[worse] /= 2
        at[worse] -= step[worse]
        ok = ~worse & ~done
        best[ok] = got[ok, 0]
        grad, curve = got[:, 1 : d + 1], got[:, d + 1 :].reshape(models, d, d)
        for m in np.flatnonzero(ok):
            step[m] = -np.linalg.lstsq(curve[m] + 1e-12 * np.eye(d), grad[m], rcond=None)[0]
            at[m] += step[m]
            done[m] = np.abs(step[m]).max() < 1e-10
        done |= worse & (np.abs(step).max(axis=1) < 1e-10)
        if done.all():
            break
    return at


def learn(df: DataFrame, columns: Sequence[str], label: str, setups: Sequence[Setup] = (Setup(),), fold: Column | None = None, folds: int = 1) -> dict[tuple[int, int], Weights]:
    """Weights by (setup, fold left out): logistic regressions, either class weighing the same, of all setups and
    folds at once. Every Newton step is one pass, in which a task sums what its rows say to each model; a
    model's sums are as many numbers as its columns squared."""
    n, d, models = len(columns), len(columns) + 1, len(setups) * folds
    rows = df.select(
        F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]).alias("x"), (F.col(label) == 1).cast("double").alias("y"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold"),
        F.array(*[((F.col(label) == 1) | F.expr(s.condition)).cast("double") for s in setups]).alias("in"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = standard(df, columns, label, setups)
        counts = rows.groupBy("fold", "y").agg(*[F.sum(F.get("in", k)).alias(f"c{k}") for k in range(len(setups))]).collect()
        mean, scale = (np.array([[e[c][j] for c in columns] for e in ends]) for j in (0, 1))
        used = np.array([[c not in s.without for c in columns] for s in setups], float)
        class_weight = np.ones((len(setups), folds, 2))
        for k in range(len(setups)):
            for f in range(folds):
                size = [sum(r[f"c{k}"] for r in counts if r["fold"] != f and r["y"] == y) for y in (0.0, 1.0)]
                class_weight[k, f] = [sum(size) / (2 * c) if c else 0.0 for c in size]

        def add(at: np.ndarray):
            def run(batches: Iterable[pa.RecordBatch]):
                total = np.zeros((models, 1 + d + d * d))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = batch.column(0).flatten().to_numpy().reshape(-1, n)
                    y, own_fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                    inside = batch.column(3).flatten().to_numpy().reshape(-1, len(setups))
                    for k in range(len(setups)):
                        z = np.column_stack([(x - mean[k]) / scale[k] * used[k], np.ones(len(x))])
                        for f in range(folds):
                            m = k * folds + f
                            w = inside[:, k] * (own_fold != f) * class_weight[k, f][y.astype(int)]
                            s = z @ at[m]
                            p = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
                            total[m, 0] += (w * (np.logaddexp(0, s) - y * s)).sum()
                            total[m, 1 : d + 1] += z.T @ (w * (p - y))
                            total[m, d + 1 :] += (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

            return run

        def sums(at: np.ndarray) -> np.ndarray:
            got = rows.mapInArrow(add(at), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
            out = np.zeros(models * (1 + d + d * d))
            for r in got:
                out[r["at"]] = r["v"]
            out = out.reshape(models, -1)
            for m in range(models):
                ridge = np.append(np.full(n, 1 / setups[m // folds].strength), 0.0)
                out[m, 0] += 0.5 * (ridge * at[m] ** 2).sum()
                out[m, 1 : d + 1] += ridge * at[m]
                out[m, d + 1 :] += np.diag(ridge).ravel()
            return out

        at = _newton(sums, models, d)
    finally:
        rows.unpersist()
    raw = {}
    for m in range(models):
        k, f = divmod(m, folds)
        w = at[m, :n] * used[k] / scale[k]
        raw[k, f] = dict(zip(columns, w.tolist())), float(at[m, n] - (w * mean[k]).sum())
    return raw


def fit(df: DataFrame, columns: Sequence[str], label: str, strength: float = 1.0) -> Weights:
    """The weights of one regression over all rows, to be used on raw features."""
    return learn(df, columns, label, (Setup(strength=strength),))[0, 0]


def fold_of(id_: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_), F.lit("fold")), F.lit(folds)).cast("int")


def scored(weights: dict[tuple[int, int], Weights], setup: int, fold: Column, folds: int) -> Column:
    """A row's score by the model of the other folds."""
    out = None
    for f in range(folds):
        own = linear(*weights[setup, f])
        out = F.when(fold == f, own) if out is None else out.when(fold == f, own)
    return out


def out_of_fold(df: DataFrame, columns: Sequence[str], label: str, id_: str, folds: int = 5, strength: float = 1.0) -> DataFrame:
    """(id, label, score): each row scored by a model of the other folds; folds go by a hash of the id."""
    fold = fold_of(id_, folds)
    weights = learn(df, columns, label, (Setup(strength=strength),), fold, folds)
    return df.select(F.col(id_).alias("id"), F.col(label).cast("double").alias("label"), scored(weights, 0, fold, folds).alias("score"))


def sweep(df: DataFrame, columns: Sequence[str], label: str, id_: str, strengths: Sequence[float], folds: int = 5) -> DataFrame:
    """(config, rows, auc): the out-of-fold AUC of each strength."""
    return compared(df, columns, label, id_, {str(c): Setup(strength=c) for c in strengths}, folds)


def oof_auc(scores: DataFrame) -> float | None:
    """AUC of decision scores, brought into (0, 1) in order."""
    return auc(scores.select("label", squeezed(F.col("score")).alias("probability")), target="label").first()["auc"]


def squeezed(score: Column) -> Column:
    return F.atan(score) / 3.1415926535898 + 0.5


def compared(df: DataFrame, columns: Sequence[str], label: str, id_: str, setups: dict[str, Setup], folds: int = 5) -> DataFrame:
    """(config, rows, auc) of each setup by models of the other folds, all in one plan over one scan."""
    fold = fold_of(id_, folds)
    weights = learn(df, columns, label, list(setups.values()), fold, folds)
    each = F.array(*[
        F.when((F.col(label) == 1) | F.expr(s.condition), F.struct(F.lit(name).alias("config"), squeezed(scored(weights, k, fold, folds)).alias("probability")))
        for k, (name, s) in enumerate(setups.items())
    ])
    long = df.select(F.col(label).cast("double").alias("label"), F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("label", "e.*")
    rows = long.groupBy(F.col("config").alias("_config")).agg(F.count(F.lit(1)).alias("rows"))
    return auc(long, ["config"], target="label").join(rows, F.col("config") == F.col("_config")).select("config", "rows", "auc")


def linear(weights: dict[str, float], intercept: float) -> Column:
    out = F.lit(intercept)
    for c, w in weights.items():
        out = out + F.lit(w) * F.col(f"`{c}`")
    return out


def operating_point(df: DataFrame, score: Column, label: str, flag_rate: float) -> DataFrame:
    """One row: the real population's score that so many exceed, and the share of either population above it."""
    at = df.select(F.col(label).alias("label"), score.alias("s"))
    threshold = exact_percentiles(at.where("label = 0"), F.col("s"), {"threshold": 1 - flag_rate})
    share = lambda k: F.avg(F.when(F.col("label") == k, (F.col("s") > F.col("threshold")).cast("int")))
    return at.crossJoin(F.broadcast(threshold)).groupBy("threshold").agg(share(0).alias("flag_rate_real"), share(1).alias("flag_rate_emitted"))


def controls(df: DataFrame, columns: Sequence[str], label: str, id_: str, configurations: dict[str, tuple[str, Sequence[str]]], folds: int = 5) -> DataFrame:
    """(config, rows, auc): how well populations are told apart when the real one is narrowed by a condition (to
    a matched neighbourhood, say) or features are left out. A configuration is (condition on the real rows,
    columns left out)."""
    return compared(df, columns, label, id_, {name: Setup(condition, tuple(without)) for name, (condition, without) in configurations.items()}, folds)


def signals(rows: DataFrame, columns: Sequence[str], score: str, rate: str, test: str, cluster: Sequence[str], samples: int = 500, seed: int = 11) -> DataFrame:
    """One row: whether features beside the score explain what validation holds against it, so that adjusted
    scores err less on the test. Least squares on the features; the gain's interval from a bootstrap of
    clusters by hashed Poisson counts."""
    data = rows.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"), (F.col(rate) - F.col(score)).alias("label"), F.col(score).alias("s"), F.col(test).alias("t"), F.concat_ws("|", *cluster).alias("unit"))
    model = LinearRegression(solver="normal", regParam=0.0).fit(data)
    at = model.transform(data).select("unit", F.abs(F.col("s") - F.col("t")).alias("raw"), F.abs(F.col("s") + F.col("prediction") - F.col("t")).alias("adjusted"))
    units = at.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw") - F.col("adjusted")).alias("gain")).cache()
    draws = units.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("w", poisson_one(F.col("unit"), F.col("sample"), seed))
    means = draws.groupBy("sample").agg((F.sum(F.col("w") * F.col("gain")) / F.nullif(F.sum(F.col("w") * F.col("n")).cast("double"), F.lit(0.0))).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    whole = at.agg(F.avg("raw").alias("raw_mae"), F.avg("adjusted").alias("adjusted_mae")).crossJoin(units.agg(F.count(F.lit(1)).alias("clusters"))).crossJoin(interval)
    named = {f"c_{c}": F.lit(float(v)) for c, v in zip(columns, model.coefficients.toArray())}
    return whole.withColumns(named | {"intercept": F.lit(float(model.intercept)), "recommended": F.col("low") > 0})


def split_selection(members: DataFrame, pool: str, candidate: str, member: str, score: str) -> DataFrame:
    """(member, pools, promised, observed): each member's winner of every pool, by its own score and by the mean
    of the others, which had no part in choosing it."""
    own = members.groupBy(pool, F.col(member).alias("m")).agg(F.max_by(F.col(candidate), F.struct(F.col(score), F.col(candidate))).alias("winner"), F.max(score).alias("promised"))
    other = members.select(F.col(pool).alias("_p"), F.col(candidate).alias("_c"), F.col(member).alias("_m"), F.col(score).alias("_s"))
    met = own.join(other, (F.col(pool) == F.col("_p")) & (F.col("winner") == F.col("_c")) & (F.col("m") != F.col("_m")))
    per = met.groupBy(pool, "m", "promised").agg(F.avg("_s").alias("observed"))
    return per.groupBy(F.col("m").alias("member")).agg(F.count(F.lit(1)).alias("pools"), F.avg("promised").alias("promised"), F.avg("observed").alias("observed"))
