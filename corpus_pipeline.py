"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tiltyard.llm import mixing, neardup, packing, quality, secrets
from tiltyard.llm.base import dropped, materialize
from tiltyard.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and so go; long texts are judged whole; repeated rows and rows that
    share an id or have none are each judged by their own text, so equal texts (ties) have one fate; an empty
    table stays empty; other columns stay as they are, whatever they are called.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.

    It is the one of the least id, null ids last; where ids tie, that of the least hash of its text; of repeated
    rows one. Texts without words (null and empty ones too) are no one's copies and stay. Long texts are compared
    whole; an empty table stays empty; other columns stay as they are, whatever they are called.
    """
    return neardup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced; all documents stay.

    Null texts stay null and empty ones empty; long texts are scanned whole; overlapping secrets are replaced as
    one; repeated rows and null ids are rows like others; an empty table stays empty; other columns stay as they
    are, but ``n_chars`` follows the text.
    """
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, at their source's rate, and shuffled.

    A null source is a source of its own; null and empty texts count one byte; rows that share an id, or have
    none, get the same draw; an empty table stays empty. All columns stay, ones called like the operator's own too.
    """
    names = {n: f"{n}_{uuid.uuid4().hex}" for n in ("copy", "key")}
    return mixing.mix(docs, **names).drop(*names.values())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of token sequences, with their token ids.

    A null or empty text is its end's id alone; long texts are cut into pieces, none is left out; each row is
    packed as often as it is there, rows of one id or none too; rows of one length are told apart by their order
    alone; other columns go; an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer_path(), ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("mix_sources", mixing_stage),
    ("pack", packing_stage),
]

ORACLE_SQL = None  # packing and learned rules have no SQL; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``: each one's rows are written to the shared folder and read as the next one's,
    and go when that one's are written; the last ones' stay until the session ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
