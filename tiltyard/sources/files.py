"""File and table sources and sinks."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltyard.schema import FACT, PAYLOAD


def battles(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Battle shards under a path or glob, nested folders too. The schema is given, so columns that old shards
    lack are null and nothing is read to infer it."""
    out = spark.read.schema(FACT).option("recursiveFileLookup", True).parquet(path)
    return out.select(*columns) if columns else out


def raw_battles(spark: SparkSession, path: str) -> DataFrame:
    """Raw payloads, one JSON object a line, as text and parsed."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.from_json("value", PAYLOAD).alias("battle"))


def tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags of a text file, a line each; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("tag")).where((F.col("tag") != "") & (F.col("tag") != "#") & ~F.col("tag").startswith("//"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a catalogue's JSON: {"cards": [{id, roles, kind, targets, transport, elixir}]}."""
    card = "array<struct<id: bigint, name: string, roles: array<string>, kind: string, targets: string, transport: string, elixir: int>>"
    rows = spark.read.schema(f"cards {card}").option("multiLine", True).json(path)
    return rows.select(F.explode("cards").alias("c")).select(F.col("c.id").alias("card"), "c.name", F.coalesce("c.roles", F.array()).alias("roles"), "c.kind", "c.targets", "c.transport", "c.elixir").where("card is not null")


def lookup(df: DataFrame, key: str, wanted: DataFrame, other: str) -> DataFrame:
    """Rows whose key is wanted: a semi-join, which Spark broadcasts if the keys are few."""
    return df.join(wanted.select(F.col(other).alias("_wanted")), F.col(key) == F.col("_wanted"), "left_semi")


def after(keys: Sequence[str], start: Sequence[Column]) -> Column:
    """The rows after a place in the order of several columns, with the first column's own bound beside it, so
    that the scan can use it."""
    whole = F.struct(*keys) > F.struct(*[s.alias(k) for s, k in zip(start, keys)])
    return (F.col(keys[0]) >= start[0]) & whole


def keyset_page(df: DataFrame, keys: Sequence[str], start: Sequence[Column], rows: int) -> DataFrame:
    """The next page of an ordered table: a top-k, without counting what came before."""
    return df.where(after(keys, start)).orderBy(*keys).limit(rows)


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or in the warehouse where none is named."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/work-{uuid.uuid4().hex}"


def pull(df: DataFrame, keys: Sequence[str], path: str, cursor: str, rows: int | None = None) -> int:
    """The rows of an ordered table after the cursor, a page of ``rows`` of them or all, as a folder of ``path``; then
    the cursor moves to the last of them. Gives the number of rows.

    A page's folder is named after the cursor that it began at and is written over, so a pull that was lost before its
    cursor moved is done again without rows twice. Rows with a null key have no place in the order and never come.
    """
    spark = df.sparkSession
    conf, at = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(cursor)
    page, name = df.dropna(how="any", subset=list(keys)), "first"
    if at.getFileSystem(conf).exists(at):
        last = spark.read.parquet(cursor).select(*[F.col(k).cast("string") for k in keys]).first()
        page = page.where(after(keys, [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, last)]))
        name = hashlib.md5(json.dumps(list(last)).encode()).hexdigest()
    folder = f"{path.rstrip('/')}/page-{name}"
    (page if rows is None else page.orderBy(*keys).limit(rows)).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    done = spark.read.schema(df.schema).parquet(folder)
    end = done.agg(F.max(F.struct(*keys)).alias("k"), F.count(F.lit(1)).alias("n")).first()
    if end["n"]:
        replace(done.agg(F.max(F.struct(*keys)).alias("k")).select("k.*"), cursor)
    return end["n"]


def pulled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All pages so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def vectors(spark: SparkSession, path: str, column: str, size: int) -> DataFrame:
    """A table of vectors; one that has another length, or none, is an error."""
    df = spark.read.parquet(path)
    wrong = df.where(~F.coalesce(F.size(column) == size, F.lit(False))).count()
    if wrong:
        raise ValueError(f"{wrong} vectors of {path} don't have {size} numbers")
    return df


def first_path(column: str, paths: Sequence[str]) -> Column:
    """The first of several JSON paths that holds anything, as an integer, or null."""
    return F.coalesce(*[F.get_json_object(column, p) for p in paths]).try_cast("int")


def read_table(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int, int], **options: str) -> DataFrame:
    """A JDBC table in parallel ranges of a numeric key (lower, upper, partitions), rows fetched in batches."""
    lower, upper, partitions = bounds
    ranges = {"partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **ranges, **options).load()


def write_shards(df: DataFrame, path: str, rows: int = 50_000, mode: str = "append") -> None:
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder a split, so that readers of one prune the others."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(column).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside the path and swap, so that a reader sees the old table or the new one; ``df`` may read the
    old one."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.option("compression", "zstd").parquet(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(at(new), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"{new} can't be moved to {path}")
    if had:
        fs.delete(at(old), True)


def replace_column(df: DataFrame, name: str, values: DataFrame, key: str) -> DataFrame:
    """One column anew from (key, name), other columns as they are; rows without a value keep theirs."""
    new = values.select(F.col(key).alias("_key"), F.col(name).cast(df.schema[name].dataType).alias("_new"))
    return df.join(new, F.col(key) == F.col("_key"), "left").select([F.coalesce("_new", name).alias(c) if c == name else F.col(c) for c in df.columns])


def materialized(df: DataFrame, path: str, signature: dict) -> DataFrame:
    """A table kept under a path as long as its signature (whatever it was made from) stays the same."""
    spark = df.sparkSession
    said = json.dumps(signature, sort_keys=True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".signature")
    if not (mark.getFileSystem(conf).exists(mark) and spark.read.text(str(mark)).orderBy("value").first()[0] == said):
        replace(df, path)
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(str(mark))
    return spark.read.schema(df.schema).parquet(path)


def one_row_json(df: DataFrame) -> str:
    """A one-row report as JSON."""
    row = df.select(F.to_json(F.struct("*"))).first()
    return row[0] if row else "{}"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
