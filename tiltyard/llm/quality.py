"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditions."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import Chunk, as_arrow, chunks, mix, numbered, small_batches, span_hashes, trim

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_echoes")
#: At most so many labelled rows, those with the least hash of their id, teach the list.
LABELLED_ROWS = 20_000

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", range(65, 91), range(48, 58), b"!?"))
_WINDOW = numbered(8, 2)


def repeated_in(part: Chunk, hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a window of 8 words found twice or more in their text."""
    at = part.windows(8)
    key = mix(part.doc[at].astype(np.uint64) + np.uint64(1))
    for k in range(8):
        key += hashes[at + k] * _WINDOW[k]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(hashes), bool)
    at = at[np.isin(key, np.unique(twice))]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + 8, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_words(part: Chunk, hashes: np.ndarray) -> np.ndarray:
    return np.bincount(part.doc, weights=repeated_in(part, hashes), minlength=part.n).astype(np.int64)


def echoes(part: Chunk, hashes: np.ndarray) -> np.ndarray:
    """The words of each text that are the same as the word before them."""
    same = (hashes[1:] == hashes[:-1]) & (part.doc[1:] == part.doc[:-1])
    return np.bincount(part.doc[1:][same], minlength=part.n)


def distinct_within(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each text has."""
    if not len(hashes):
        return np.zeros(n, np.int64)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[first], minlength=n)


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each whole text; a null text counts as none, so all of its are 0."""
    out: dict[str, list] = {k: [] for k in COUNTS}
    for part in chunks(column):
        hashes = part.hashes()
        point = (part.data & 0xC0) != 0x80
        lines = _lines(part)
        values = {
            "n_words": part.n_words,
            "word_chars": part.per_text(part.inside & point),
            "n_symbols": part.per_text(_SYMBOL[part.data]),
            "n_dup_lines": lines[1],
            "n_repeat_words": repeated_words(part, hashes),
            "n_lines": lines[0],
            "n_upper": part.per_text(_UPPER[part.data]),
            "n_digits": part.per_text(_DIGIT[part.data]),
            "n_marks": part.per_text(_MARK[part.data]),
            "n_echoes": echoes(part, hashes),
        }
        for k in COUNTS:
            out[k].append(values[k])
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _lines(part: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The lines of each text that have a word, and those of them equal to an earlier one."""
    breaks = np.flatnonzero(part.data == 10)
    cuts = np.union1d(breaks, part.offsets)
    start = np.union1d(breaks + 1, part.offsets[:-1])  # a line begins after a break or where a text does
    start = start[start < len(part.data)]
    start = start[part.data[start] != 10]
    end = cuts[np.searchsorted(cuts, start, "right")]
    words = np.concatenate(([0], np.cumsum(part.inside)))
    has = words[end] > words[start]
    start, end = start[has], end[has]
    doc = np.searchsorted(part.offsets, start, "right") - 1
    n = np.bincount(doc, minlength=part.n)
    return n, n - distinct_within(doc, span_hashes(part.data, start, end), part.n)


# The list -------------------------------------------------------------------------------------------

#: What the rules' thresholds are held against, made from the counts.
RATES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_rate": ("n_symbols", "word_chars"),
    "line_repetition": ("n_dup_lines", "n_lines"),
    "window_repetition": ("n_repeat_words", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "digit_rate": ("n_digits", "word_chars"),
    "mark_rate": ("n_marks", "word_chars"),
    "echo_rate": ("n_echoes", "n_words"),
}

Condition = tuple[str, bool, float]  # the rate, whether it must be above or else at most, the threshold


def rates(counts: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([counts[a] / (np.maximum(counts[b], 1) if b else 1) for a, b in RATES.values()]).astype(float)


def rate_column(name: str, counts: Column) -> Column:
    a, b = RATES[name]
    top = counts[a].cast("double")
    return top / F.greatest(counts[b], F.lit(1)).cast("double") if b else top


def covering(x: np.ndarray, bad: np.ndarray, precision: float = 0.97, least: int = 4, conditions: int = 4) -> list[list[Condition]]:
    """Sequential covering: while rules can be found, grow a conjunction on two thirds of the rows by
    information gain, prune it from its end on the other third, keep it if it is precise, and go on with the
    rows that it leaves."""
    names = list(RATES)
    alive, grows = np.ones(len(bad), bool), np.arange(len(bad)) % 3 != 2
    rules: list[list[Condition]] = []

    def holds(rule: list[Condition]) -> np.ndarray:
        return reduce(np.logical_and, ((x[:, names.index(n)] > t) if above else (x[:, names.index(n)] <= t) for n, above, t in rule), np.ones(len(bad), bool))

    while (alive & bad).sum() >= least and len(rules) < 32:
        rule: list[Condition] = []
        inside = alive & grows
        while len(rule) < conditions and (inside & ~bad).any() and (inside & bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best = (1e-9, None)
            for j, name in enumerate(names):
                for t in np.unique(np.quantile(x[inside & bad, j], np.linspace(0, 1, 33))):
                    for above, cut in ((True, np.nextafter(t, -np.inf)), (False, t)):
                        hit = inside & ((x[:, j] > cut) if above else (x[:, j] <= cut))
                        p, n = (hit & bad).sum(), (hit & ~bad).sum()
                        if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0]:
                            best = (gain, (name, above, _between(x[:, j], cut, above)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= holds([best[1]])

        def worth(r: list[Condition]) -> float:
            hit = holds(r) & alive & ~grows
            return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = holds(rule) & alive if rule else np.zeros(len(bad), bool)
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def _between(values: np.ndarray, cut: float, above: bool) -> float:
    """The middle of the gap in which the cut lies."""
    low, high = values[values <= cut], values[values > cut]
    return float((low.max() + high.min()) / 2) if len(low) and len(high) else float(cut)


def as_column(rules: list[list[Condition]], counts: Column) -> Column:
    """The number of the first rule that holds, from 1, or 0: an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, [rate_column(n, counts) > t if above else rate_column(n, counts) <= t for n, above, t in rule])
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a struct column of the statistics, in one pass over the texts."""
    target = f"struct<{','.join(f'{k}:bigint' for k in COUNTS)}>"
    schema = docs.select("*", F.lit(None).cast(target).alias(name)).schema

    def run(batches):
        for batch in batches:
            values = counts_of(batch.column(batch.schema.get_field_index("text")))
            made = pa.StructArray.from_arrays([as_arrow(values[k], pa.int64()) for k in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])
            trim()

    return small_batches(docs).mapInArrow(run, schema)


def learn_rules(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, precision: float = 0.97) -> list[list[Condition]]:
    """The decision list for ``quality`` 0, learned from at most ``rows`` labelled documents.

    Labels that are null, or of no document, teach nothing; without both qualities the list is empty. Where ids
    repeat, labels meet more documents than there are labels; the bound is on the documents, those with the least
    hash of their id, and ties among them go by their statistics.
    """
    chosen = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    seen = with_counts(joined, "_counts").select("doc_id", "quality", "_counts.*")
    # A limit under an order keeps each partition's least rows only, so the statistics are made once.
    got = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *COUNTS).limit(rows).toPandas()
    if got["quality"].nunique() < 2:
        return []
    order = np.argsort(mix(got["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
    counts = {k: got[k].to_numpy()[order] for k in COUNTS}
    return covering(rates(counts), got["quality"].to_numpy()[order] == 0, precision)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (counts["n_repeat_words"] * 100 > counts["n_words"] * 30)


def quality_rules(docs: DataFrame, labels: DataFrame, rules: list[list[Condition]] | None = None) -> DataFrame:
    """Rows (doc_id, the counts, base_failed, rule, kept), one a row of ``docs``.

    ``kept`` is false where the fixed base conditions fail or a rule of the learned list holds; ``rule`` is
    that rule's number or 0. A null or empty text has counts of 0 and so fails; repeated rows and null ids
    give their own rows; further columns are ignored; texts are taken whole. An empty table gives none.
    """
    rules = learn_rules(docs, labels) if rules is None else rules
    c = F.col("_counts")
    out = with_counts(docs.select("doc_id", "text"), "_counts")
    out = out.select("doc_id", "_counts", base_failed(c).alias("base_failed"), as_column(rules, c).alias("rule"))
    return out.select("doc_id", "_counts.*", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, rules: list[list[Condition]] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever they are called."""
    rules = learn_rules(docs, labels) if rules is None else rules
    name = "q" + uuid.uuid4().hex
    c = F.col(name)
    return with_counts(docs, name).where(~base_failed(c) & (as_column(rules, c) == 0)).drop(name)
