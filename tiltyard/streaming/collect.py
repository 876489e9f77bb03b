"""Collecting battles as a stream: deduplication, freshness, running counts, archiving; and the crawl's frontier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltyard.functions.segments import TROPHIES, ladder_band


def read(spark: SparkSession, path: str, schema: T.StructType | str, files_a_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a path as they come; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def fresh(df: DataFrame, time: str, since: Column) -> DataFrame:
    """Rows at or after a time; undatable ones are late."""
    return df.where(F.coalesce(F.col(time) >= since, F.lit(False)))


def deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key; state goes as the watermark passes."""
    if stream.schema[time].dataType != T.TimestampType():
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def running_counts(stream: DataFrame, by: str) -> DataFrame:
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, by: str, size: str, delay: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> None:
    """All that there is now, exactly once, into Parquet; run again, it goes on where it ended."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    (writer.partitionBy(partition_by) if partition_by else writer).start().awaitTermination()


def archive(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], seen: Callable[[DataFrame, int], None], delete: Callable[[DataFrame, int], None]) -> None:
    """Micro-batches in strict order: written, then marked as seen, then deleted at the source. A batch that
    fails is run again whole, so the three must bear being repeated for one batch id."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write(batch, number)
            seen(batch, number)
            delete(batch, number)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# The frontier: what a crawl fetches next. A crawl's output is its next input, so it is a loop of batches. -----

FRONTIER = "tag string, band string, hop int, position bigint"


def candidates(battles: DataFrame, least: int, edges=TROPHIES) -> DataFrame:
    """Players met in battles (tag, mode_key, trophies), by band: ladder players without trophies or below
    ``least`` are left out, ranked ones always stay."""
    ladder = F.col("mode_key") == "ladder"
    band = F.when(ladder, F.coalesce(ladder_band(F.col("trophies"), edges), F.lit("ladder:overflow"))).otherwise(F.col("mode_key"))
    return battles.where(~ladder | (F.col("trophies") >= least)).groupBy("tag").agg(F.min(band).alias("band"))


def extend(frontier: DataFrame, seen: DataFrame, found: DataFrame, hop: int) -> DataFrame:
    """The frontier and the new players of a hop, none twice and none already fetched; seeds are hop 0."""
    known = frontier.select("tag").union(seen.select("tag")).distinct()
    new = found.join(known, "tag", "left_anti").select("tag", "band", F.lit(hop).alias("hop"), F.xxhash64("tag").alias("position"))
    return frontier.unionByName(new)


def next_players(frontier: DataFrame, rows: int, targets: DataFrame | None = None, bias: float = 0.0) -> DataFrame:
    """The next players, bands in proportion to their queues; with ``bias`` bands that hold fewer battles than
    the fullest (band, n) get more. Within a band by hash order. Some band always gets its first."""
    per = frontier.groupBy("band").agg(F.count(F.lit(1)).alias("queued"))
    weight = F.col("queued").cast("double")
    if targets is not None and bias > 0:
        have = targets.select(F.col("band").alias("_band"), F.col("n").alias("_n"))
        per = per.join(F.broadcast(have), F.col("band") == F.col("_band"), "left")
        top = F.max(F.coalesce("_n", F.lit(0))).over(Window.partitionBy())
        weight = weight * (1 + bias * (1 - F.coalesce("_n", F.lit(0)) / F.greatest(top, F.lit(1))))
    share = per.withColumn("weight", weight).withColumn("quota", F.greatest(F.round(F.lit(rows) * F.col("weight") / F.sum("weight").over(Window.partitionBy())), F.lit(1))).select(F.col("band").alias("q_band"), "quota")
    place = F.row_number().over(Window.partitionBy("band").orderBy("position", "tag"))
    return frontier.withColumn("place", place).join(F.broadcast(share), F.col("band") == F.col("q_band")).where(F.col("place") <= F.col("quota")).drop("place", "q_band", "quota")
