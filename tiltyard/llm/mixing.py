"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import materialize

#: A Poisson mean above this is drawn as a sum of equal parts, each with its own hash.
PART = 500.0
#: Rates are broadcast where they are no more numbers than this (8 MB); else sources are joined, dealt to SPREAD places.
NUMBERS, SPREAD = 1 << 20, 16


def uniform(seed: str, *of: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the columns: 52 bits of an MD5 digest."""
    said = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in of])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """Rows (source, parts, cdf): how often a document of a source is repeated in the mean, as the Poisson
    distribution function of one part up to where nothing of double precision is left.

    A source's target share is its weight's, or without weights its bytes to the power ``temperature``; its
    rate brings it there when ``epochs`` times all bytes are drawn. Sources without a weight get none.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("double").alias("bytes"))
    if weights is None:
        size = size.withColumn("w", F.pow("bytes", F.lit(float(temperature))))
    else:
        given = F.lit(0.0)
        for name, w in weights.items():
            given = F.when(F.col("source") == name, float(w)).otherwise(given)
        size = size.withColumn("w", given)
    whole = size.agg(F.sum("bytes").alias("all_bytes"), F.sum("w").alias("all_w"))
    rate = F.coalesce(F.col("w") / F.expr("nullif(all_w, 0)"), F.lit(0.0)) * F.col("all_bytes") * epochs / F.col("bytes")
    out = size.crossJoin(F.broadcast(whole)).select("source", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    terms = F.sequence(F.lit(1), F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all"))
    grow = lambda acc, k: F.struct(
        (acc["p"] * F.col("mean") / k).alias("p"), (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * F.col("mean") / k)).alias("all")
    )
    return out.select("source", "rate", "parts", F.aggregate(terms, start, grow)["all"].alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: str = "mix", copy: str = "copy", key: str = "shuffle_key") -> DataFrame:
    """``docs``, each row as often as its Poisson draw says, in a random order.

    The draw inverts the distribution at a hash of the seed and doc_id, so it is the same on every run and
    wherever a row lies; ``copy`` numbers a row's copies from 1, and ``key`` is what the rows were shuffled by.
    All columns stay; those that already have one of these two names take part no more (give other names to keep
    them). A null source is a source of its own, a null or empty text weighs one byte, rows with one id (a null one
    too) get the same draw, a draw that meets a step of the distribution (a tie) goes above it, and an empty table
    gives none. Rows move once, all their columns with them, to where their hash puts them.
    """
    docs = docs.drop(copy, key)
    own = {n: f"{n}_{uuid.uuid4().hex}" for n in ("source", "parts", "cdf", "u", "n", "place")}
    rate, seen = materialize(rates(docs.select("source", "text"), weights, temperature, epochs), F.coalesce(F.sum(F.size("cdf")), F.lit(0)).alias("numbers"))
    rate = rate.select(*[F.col(n).alias(own[n]) for n in ("source", "parts", "cdf")])
    id_ = F.col("doc_id")
    same = docs["source"].eqNullSafe(rate[own["source"]])
    if seen["numbers"] <= NUMBERS:
        out = docs.join(F.broadcast(rate), same)
    else:  # a source may hold a third of all rows
        place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.lit(SPREAD))
        rate = rate.withColumn(own["place"], F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
        out = docs.join(rate, same & (place == rate[own["place"]]))
    draws = F.transform(F.sequence(F.lit(1), F.col(own["parts"])), lambda j: uniform(seed, id_, j))
    count = F.aggregate(own["u"], F.lit(0), lambda acc, u: acc + F.size(F.filter(own["cdf"], lambda c: c <= u)))
    out = out.withColumn(own["u"], draws).withColumn(own["n"], count).where(F.col(own["n"]) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own["n"])))).drop(*own.values())
    said = F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("null")), F.col(copy).cast("string"))
    out = out.withColumn(key, F.md5(said.cast("binary")))
    return out.repartition(F.col(key)).sortWithinPartitions(key)


def mix_sql(temperature: float = 0.7, epochs: float = 1.0, seed: str = "mix") -> str:
    """What ``mix`` gives over ``documents``, in DuckDB's SQL, for means that are drawn in one part."""
    return f"""
    with size as (select source, cast(sum(coalesce(strlen(text), 0) + 1) as double) bytes from documents group by source),
    rate as (select source, pow(bytes, {temperature}) / (select sum(pow(bytes, {temperature})) from size)
                    * (select sum(bytes) from size) * {epochs} / bytes as mean from size),
    drawn as (select d.doc_id, r.mean,
                     cast(('0x' || substr(md5('{seed}:' || d.doc_id || ':1'), 1, 13)) as bigint) / 4503599627370496.0::double as u
              from documents d join rate r on d.source is not distinct from r.source),
    counted as (select doc_id, len(list_filter(range(0, cast(ceil(mean + 10 * sqrt(mean) + 20) as bigint) + 1),
                    lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1.0)))) <= u)) as n from drawn)
    select d.*, cast(copy as int) as copy, md5('{seed}:' || d.doc_id || ':' || copy) as shuffle_key
    from counted c join documents d using (doc_id), unnest(range(1, n + 1)) as t(copy)
    """
