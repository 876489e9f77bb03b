"""Token ids of texts, and the exact histogram of encoded lengths."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltyard.llm.base import map_arrow, materialize

#: The pre-tokenisation of byte-level tokenizer files that name no pattern of their own (a fixed value).
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 for itself, the other
    bytes in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids by a ``tokenizers`` file, without added special tokens.

    A byte-level BPE whose ids are in merge order has the same ids under ``tiktoken``, which is several
    times as fast; any other file, and any text that holds one of the file's added tokens, goes through
    ``tokenizers`` itself, which isn't built before it is needed. ``plan`` is what a driver has read of the file.
    """

    def __init__(self, plan: dict, content):
        self.added, self.content, self._slow = plan["added"], content, None
        self.fast = None
        if plan["ranks"] is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks={t: i for t, i in zip(plan["ranks"], plan["ids"].tolist())}, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.content())
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def planned(content: str) -> dict:
    """What an ``Encoder`` needs of a file: its added tokens and, where ``tiktoken`` gives the same ids, the tokens'
    bytes and ids (else None)."""
    told = json.loads(content)
    added = [t["content"] for t in told.get("added_tokens") or []]
    model, pre = told["model"], told.get("pre_tokenizer") or {}
    plan = {"key": hashlib.sha256(content.encode()).hexdigest(), "added": added, "ranks": None, "ids": None}
    plain = model.get("type") == "BPE" and not told.get("normalizer") and not model.get("dropout") and not model.get("byte_fallback")
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return plan
    of = byte_of_char()
    ids = {t: i for t, i in model["vocab"].items() if t not in added}
    if any(c not in of for t in ids for c in t):
        return plan
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    at = [ids.get(a + b, -1) for a, b in merges]
    if at != sorted(set(at)) or at[:1] == [-1] or sum(len(t) == 1 for t in ids) != 256 or len(ids) != 256 + len(at):
        return plan
    return plan | {"ranks": [bytes(of[c] for c in t) for t in ids], "ids": np.array(list(ids.values()), np.uint32)}


_held: dict[str, Encoder] = {}


class TokenizerFile:
    """A tokenizer for executors: a short plan of the file, sent once to each, and the file's content, which only
    those fetch that need it."""

    def __init__(self, df: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            content = f.read()
        plan = planned(content)
        self.key = plan["key"]
        self.plan, self.content = df.sparkSession.sparkContext.broadcast(plan), df.sparkSession.sparkContext.broadcast(content)

    def encoder(self) -> Encoder:
        """Built once a process."""
        if self.key not in _held:
            _held[self.key] = Encoder(self.plan.value, lambda: self.content.value)
        return _held[self.key]


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, n_tokens): each whole text's encoded length; a null or empty text has 0."""
    file = TokenizerFile(docs, tokenizer)

    def count(batch: pa.RecordBatch) -> dict:
        of = file.encoder()
        return {"doc_id": batch.column(0), "n_tokens": [len(of.ids(t)) if t else 0 for t in batch.column(1).to_pylist()]}

    return map_arrow(docs.select("doc_id", "text"), count, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str, block: int = 512) -> DataFrame:
    """One row for each encoded length that occurs, ascending limits for ``totals_at``:

    n_tokens, n_docs (documents of just this length), docs_below and docs_above, tokens_above (all tokens of
    longer documents), quantile (the share of documents of at most this length) and truncated_tokens (all
    tokens left when every document is cut at this length). Null and empty texts have length 0, repeated
    rows and null ids count each, documents of one length (ties) share its row, long texts are encoded whole, other
    columns are ignored, and an empty table gives no row.

    Suffix sums run within blocks of lengths, and over the blocks' totals, so that no one task holds all.
    """
    counts = materialize(token_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    all_of = sums.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    sums = sums.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.join(F.broadcast(sums), "block").select(
        "n_tokens", "n_docs",
        (F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_above"),
        (F.col("t_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_above"),
    )
    docs_to = F.col("all_docs") - F.col("docs_above")
    return above.crossJoin(F.broadcast(all_of)).select(
        "n_tokens", "n_docs", (docs_to - F.col("n_docs")).alias("docs_below"), "docs_above", "tokens_above",
        (docs_to / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_above") + F.col("n_tokens") * F.col("docs_above")).alias("truncated_tokens"),
    )


def totals_at(histogram: DataFrame, limit: int) -> DataFrame:
    """For any context limit, one row: documents, how many are longer, tokens, and tokens left by cutting."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(d), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.when(n > limit, d)), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(n * d), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.least(n, F.lit(limit)) * d), F.lit(0)).alias("tokens_left"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least this share of the documents doesn't exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
