"""Language-model scoring by a hidden Markov model, trained by Baum-Welch over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import chunks, dropped, lists, map_arrow, materialize, trim

STATES = 8  # at most 8, whose ratios fill a number of 64 bits
#: The words that every task holds, and those of them that steer all but the last round: the most frequent. Both only
#: say where a word's numbers are looked up and when they are first learned; the model has every word's own.
NEAR, LEAD = 1 << 18, 1 << 15
LEAST_OWN = 2  # rarer words are one class, which so is learned from words like those never seen
SEEDS = 256  # the most frequent words, whose company in documents starts the states
ROUNDS = 3
SEGMENT = 256  # Baum-Welch does runs of so many tokens beside each other, with what the text's other runs tell
SMOOTH = 500.0  # weight of the plain distribution in a state's emissions
BLOCK = 64  # words of a block of counts
STEP, ZERO = 16, 128  # a word's ratio to its plain share, in a state: 2 to the power (code - ZERO) / STEP
FAR_HELD = 1 << 20  # far words' counts that a task holds before it sends them


def held_out(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 7 == 2


@dataclass
class Vocabulary:
    """Sorted hashes of near words and the rank of each by falling count; their counts by rank."""

    hashes: np.ndarray
    rank: np.ndarray
    counts: np.ndarray
    least: int  # all words of at least this count are near
    lead: int  # so many of them have own emissions from the first round on
    tokens: int  # N, with ends
    types: int  # V, with the end
    ends: int

    @property
    def near(self) -> int:
        return len(self.counts)

    @property
    def total(self) -> int:
        return self.tokens + self.types + 1

    @property
    def end_weight(self) -> int:
        return self.ends + 1 if self.ends else 0

    def plain(self) -> np.ndarray:
        """The add-one distribution over symbols: leading words, all the rest, the end."""
        own = self.counts[: self.lead] + 1.0
        rest = self.total - own.sum() - self.end_weight
        return np.concatenate([own, [rest], [self.end_weight] if self.ends else []]) / self.total

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """What encoded tokens are to the leading rounds."""
        return np.where(ids < self.lead, ids, np.where((ids == self.near) & (self.ends > 0), self.lead + 1, self.lead))


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (hash, n): how often each word occurs, summed within batches and then across."""

    def count(batch: pa.RecordBatch) -> dict | None:
        found = [part.hashes() for part in chunks(batch.column(0), lower=True)]
        words, n = np.unique(np.concatenate(found), return_counts=True)
        return {"hash": words.view(np.int64), "n": n}

    return map_arrow(docs.select("text"), count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, tokens: int, types: int, ends: int, near: int = NEAR, lead: int = LEAD) -> Vocabulary:
    """The near words are those of at least the least count that at most ``near`` words reach."""
    top = 1 << 16
    by_count = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, words = top + 1, 0
    for r in sorted(by_count, key=lambda r: -r["n"]):
        words += r["words"]
        if words > near:
            break
        least = r["n"]
    got = counts.where(F.col("n") >= least).toPandas()
    got = got.sort_values(["n", "hash"], ascending=[False, True])
    hashes, n = got["hash"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order.astype(np.int32), n, least, min(lead, int((n >= LEAST_OWN).sum())), tokens + ends, types + (ends > 0), ends)


def numbered_within(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of texts: each one's number among its text's distinct words, those words, and how many each has."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    own = np.bincount(d[new], minlength=n)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1 - (np.cumsum(own) - own)[d]
    return number, h[new], own


def encoded(docs: DataFrame, shared) -> DataFrame:
    """One row a document: its tokens in order with the end, as ranks of near words, then the end, then the numbers
    of its other words, whose hashes are in ``far``."""

    def encode(batch: pa.RecordBatch) -> dict:
        v: Vocabulary = shared.value
        out: dict[str, list] = {k: [] for k in ("n", "ids", "far", "far_n")}
        for part in chunks(batch.column(1), lower=True):
            hashes = part.hashes()
            ids = np.empty(len(hashes), np.int64)
            known = np.zeros(len(hashes), bool)
            if v.near:
                at = np.minimum(np.searchsorted(v.hashes, hashes), v.near - 1)
                known = v.hashes[at] == hashes
                ids[known] = v.rank[at[known]]
            number, far, own = numbered_within(part.doc[~known], hashes[~known], part.n)
            ids[~known] = v.near + 1 + number
            out["n"].append(part.n_words)
            out["ids"].append(np.insert(ids, part.bounds[1:], v.near))
            out["far"].append(far.view(np.int64))
            out["far_n"].append(own)
        flat = {k: np.concatenate(x) for k, x in out.items()}
        return {
            "doc_id": batch.column(0), "n_words": flat["n"], "ids": lists(flat["ids"].astype(np.int32), flat["n"] + 1, pa.int32()),
            "far": lists(flat["far"], flat["far_n"], pa.int64()),
        }

    rows = map_arrow(docs.select("doc_id", "text"), encode, "doc_id long, n_words long, ids array<int>, far array<long>")
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id())


# The model ------------------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # symbols x S


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each list begins, with the end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each list into runs of at most ``size``: starts, lengths and the list of each, by list."""
    n = np.diff(offsets)
    parts = -(-n // size)
    which = np.repeat(np.arange(len(n)), parts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][which] + at * size
    return start, np.minimum(size, offsets[1:][which] - start), which


def carried(ids: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' runs, in order: whether each is its text's first, the states' shares at the end of the run before
    it, and the weights that the runs after it give to the states at its own end."""
    n, s = len(which), len(m.start)
    first = np.ones(n, bool)
    first[1:] = which[1:] != which[:-1]
    came, after = np.zeros((n, s)), np.ones((n, s))
    later = np.flatnonzero(~first)
    if len(later):
        mats = np.concatenate([_matrices(ids, start[x], size[x], m)[0] for x in np.split(later, range(2000, len(later), 2000))])
        begun = later[first[later - 1]] - 1
        came[begun + 1] = _vectors(ids, start[begun], size[begun], m)[0]
        for i, r in enumerate(later):
            if r + 1 < n and not first[r + 1]:
                v = came[r] @ mats[i]
                came[r + 1] = v / v.sum()
        for i in range(len(later) - 1, -1, -1):
            v = mats[i] @ after[later[i]]
            after[later[i] - 1] = v / v.sum()
    return first, came, after


def expected_texts(ids: np.ndarray, offsets: np.ndarray, m: Model, counts: dict[str, np.ndarray], size: int = SEGMENT, tally: np.ndarray | None = None) -> None:
    """Add the expected counts of whole texts, about 2000 runs at a time (one text's, if it has more). ``tally`` says
    which line of the emissions' counts a token is added to, if not the one of its symbol."""
    start, length, which = runs(offsets, size)
    lo = 0
    while lo < len(start):
        hi = int(np.searchsorted(which, which[min(lo + 2000, len(start) - 1)])) if lo + 2000 < len(start) else len(start)
        if hi <= lo:
            hi = int(np.searchsorted(which, which[lo], "right"))
        first, came, after = carried(ids, start[lo:hi], length[lo:hi], which[lo:hi], m)
        for a in range(lo, hi, 2000):
            b = min(a + 2000, hi)
            own = slice(a - lo, b - lo)
            expected(ids, start[a:b], length[a:b], m, counts, first[own], came[own], after[own], tally)
        lo = hi


def expected(
    ids: np.ndarray, start: np.ndarray, size: np.ndarray, m: Model, counts: dict[str, np.ndarray],
    first: np.ndarray | None = None, came: np.ndarray | None = None, after: np.ndarray | None = None, tally: np.ndarray | None = None,
) -> None:
    """Add the expected counts of sequences by scaled forward and backward recursions, all in step; of whole texts,
    or of runs of them with what ``carried`` gives for these."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    long, s = int(size[0]), len(m.start)
    first = np.ones(len(size), bool) if first is None else first[order]
    came = np.zeros((len(size), s)) if came is None else came[order]
    after = np.ones((len(size), s)) if after is None else after[order]
    active = np.searchsorted(-size, -np.arange(long), "left")  # sequences longer than t
    before = np.concatenate(([0], np.cumsum(active)))
    at = np.concatenate([start[: active[t]] + t for t in range(long)])
    emit = m.emit[ids[at]]
    alpha = np.empty_like(emit)
    scale = np.empty(len(emit))
    a = np.where(first[:, None], m.start, came @ m.move)
    for t in range(long):
        part = slice(before[t], before[t + 1])
        a = (a if t == 0 else a[: active[t]] @ m.move) * emit[part]
        scale[part] = a.sum(axis=1)
        a = a / scale[part][:, None]
        alpha[part] = a
    gamma = np.empty_like(emit)
    beta = after / (alpha[before[size - 1] + np.arange(len(size))] * after).sum(axis=1)[:, None]
    for t in range(long - 1, -1, -1):
        part = slice(before[t], before[t + 1])
        n = active[t]
        gamma[part] = alpha[part] * beta[:n]
        if t:
            ahead = emit[part] * beta[:n] / scale[part][:, None]
            counts["move"] += alpha[before[t - 1] : before[t - 1] + n].T @ ahead
            beta[:n] = ahead @ m.move.T
        else:
            counts["move"] += came.T @ (emit[part] * beta / scale[part][:, None])  # from the run before; zeros at a text's first
    counts["start"] += gamma[: active[0]][first].sum(axis=0)
    line = (ids if tally is None else tally)[at]
    for k in range(s):
        counts["emit"][:, k] += np.bincount(line, weights=gamma[:, k], minlength=len(counts["emit"]))


def log_likelihoods(ids: np.ndarray, offsets: np.ndarray, m: Model, size: int = 512) -> np.ndarray:
    """log10 of each whole sequence's probability by the scaled forward recursion.

    A sequence's first run carries a vector of states. Its further runs are done beside it, each as the matrix
    from the state before it to the state at its end, and then multiplied in order, which is the same sum.
    """
    start, length, which = runs(offsets, size)
    first = np.ones(len(which), bool)
    first[1:] = which[1:] != which[:-1]
    out = np.zeros(len(offsets) - 1)
    s = len(m.start)
    end, log = _vectors(ids, start[first], length[first], m)
    out[which[first]] += log
    later = np.flatnonzero(~first)
    if len(later):
        place = np.cumsum(first) - 1
        mats, logs = _matrices(ids, start[later], length[later], m)
        for i, r in enumerate(later):
            v = end[place[r]] @ mats[i]
            total = v.sum()
            end[place[r]] = v / total
            out[which[r]] += logs[i] + np.log10(total)
    assert end.shape[1] == s
    return out


def _vectors(ids, start, size, m: Model) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    a = np.broadcast_to(m.start, (len(start), len(m.start))).copy()
    log = np.zeros(len(start))
    for t, n in enumerate(active):
        e = m.emit[ids[start[:n] + t]]
        now = (a[:n] if t == 0 else a[:n] @ m.move) * e
        total = now.sum(axis=1)
        a[:n] = now / total[:, None]
        log[:n] += np.log10(total)
    back = np.argsort(order)
    return a[back], log[back]


def _matrices(ids, start, size, m: Model) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    s = len(m.start)
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    a = np.broadcast_to(np.eye(s), (len(start), s, s)).copy()
    log = np.zeros(len(start))
    for t, n in enumerate(active):
        now = (a[:n].reshape(-1, s) @ m.move).reshape(n, s, s) * m.emit[ids[start[:n] + t]][:, None, :]
        total = now.max(axis=(1, 2))
        a[:n] = now / total[:, None, None]
        log[:n] += np.log10(total)
    back = np.argsort(order)
    return a[back], log[back]


def summed(df: DataFrame, fn) -> dict[int, np.ndarray]:
    """The sums of the blocks of numbers that ``fn`` makes of a partition's batches, added across partitions
    a few blocks a task; what comes back is as large as one partition's. Blocks of zeros aren't sent, others with
    24 bits a number."""

    def make(batches: Iterable[pa.RecordBatch]):
        for block, values in fn(batches):
            if values.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], ["block", "data"])
        trim()

    def add(batches: Iterable[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data, np.float32).astype(np.float64)
                total[block] = total[block] + values if block in total else values
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "data"])

    kind = "block int, data binary"
    rows = df.mapInArrow(make, kind).repartition("block").mapInArrow(add, kind).collect()
    return {r["block"]: np.frombuffer(r["data"], np.float64) for r in rows}


def company(rows: DataFrame, seeds: int) -> np.ndarray:
    """In how many documents each two of the most frequent words occur together."""

    def count(batches):
        total = np.zeros((seeds, seeds), np.float64)
        for batch in batches:
            ids, off = flat_lists(batch.column(0))
            for lo in range(0, len(off) - 1, 2000):
                part = off[lo : lo + 2001]
                doc = np.repeat(np.arange(len(part) - 1), np.diff(part))
                own = ids[part[0] : part[-1]]
                has = np.zeros((len(part) - 1, seeds), np.float32)
                has[doc[own < seeds], own[own < seeds]] = 1
                total += has.T @ has
        for i in range(seeds):
            yield i, total[i]

    got = summed(rows.select("ids"), count)
    return np.array([got.get(i, np.zeros(seeds)) for i in range(seeds)])


def first_model(together: np.ndarray, plain: np.ndarray, states: int) -> Model:
    """States begun from groups of frequent words that keep company: k-means, from far-apart beginnings, over
    how much more often than by chance a word meets the others."""
    emit = np.repeat(plain[:, None], states, axis=1)
    n = len(together)
    if n >= states and together.any():
        own = np.maximum(np.diag(together), 1.0)
        x = together / np.sqrt(np.outer(own, own))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centre = [int(own.argmax())]
        while len(centre) < states:
            centre.append(int((x @ x[centre].T).max(axis=1).argmin()))
        c = x[centre]
        for _ in range(25):
            group = (x @ c.T).argmax(axis=1)
            c = np.array([x[group == k].mean(axis=0) if (group == k).any() else c[k] for k in range(states)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        emit[:n] *= 0.2
        emit[np.arange(n), group] *= 25
    else:
        emit *= 1 + 0.1 * np.cos(np.outer(np.arange(1, len(plain) + 1), np.arange(1, states + 1)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def baum_welch(rows: DataFrame, m: Model, plain: np.ndarray, v: Vocabulary | None = None) -> Model:
    """One round over all training texts: expected counts of each partition, summed, make the next model."""
    shared = rows.sparkSession.sparkContext.broadcast((m, v))
    s, symbols = len(m.start), len(plain)

    def count(batches):
        model, words = shared.value
        total = {"start": np.zeros(s), "move": np.zeros((s, s)), "emit": np.zeros((symbols, s))}
        for batch in batches:
            ids, off = flat_lists(batch.column(0))
            expected_texts(words.symbols(ids) if words else ids, off, model, total)
        total["move"] *= model.move
        yield -2, total["start"]
        yield -1, total["move"].ravel()
        for b in range(0, symbols, BLOCK):
            yield b, total["emit"][b : b + BLOCK].ravel()

    got = summed(rows.select("ids"), count)
    shared.unpersist()
    if not got:
        return m
    emit = np.zeros((symbols, s))
    for b in range(0, symbols, BLOCK):
        if b in got:
            emit[b : b + BLOCK] = got[b].reshape(-1, s)
    emit = (emit + SMOOTH * plain[:, None]) / (emit.sum(axis=0) + SMOOTH)
    return Model(*chain(got[-2], got.get(-1, np.zeros(s * s)).reshape(s, s)), emit)


def chain(start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)


def gathered(rows: DataFrame, m: Model, v: Vocabulary) -> DataFrame:
    """The last round's expected counts, of every word: rows (hash, c0, c1, ...) of words, and rows (at, v) of the
    start's, the moves' and the end's; the others' columns are null."""
    shared = rows.sparkSession.sparkContext.broadcast((m, v))
    s = len(m.start)
    columns = [f"c{k}" for k in range(s)]
    schema = "hash long, " + ", ".join(f"{c} float" for c in columns) + ", at int, v double"

    def words(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        some = counts.any(axis=1)
        none = lambda kind: pa.nulls(int(some.sum()), kind)
        return pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), *[pa.array(counts[some, k].astype(np.float32)) for k in range(s)], none(pa.int32()), none(pa.float64())], ["hash", *columns, "at", "v"])

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        hashes, line = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        counts = np.concatenate([c for _, c in held])
        return hashes, np.column_stack([np.bincount(line, weights=counts[:, k], minlength=len(hashes)) for k in range(s)])

    def run(batches: Iterable[pa.RecordBatch]):
        model, near = shared.value
        total = {"start": np.zeros(s), "move": np.zeros((s, s))}
        own, held = np.zeros((near.near + 1, s)), []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, off = flat_lists(batch.column(0))
            far, far_off = flat_lists(batch.column(1))
            hashes, line = np.unique(far.view(np.uint64), return_inverse=True)
            tally = ids.astype(np.int64)
            outside = np.flatnonzero(ids > near.near)
            text = np.searchsorted(off, outside, "right") - 1
            tally[outside] = near.near + 1 + line[far_off[text] + ids[outside] - near.near - 1]
            total["emit"] = np.zeros((near.near + 1 + len(hashes), s))
            expected_texts(near.symbols(ids), off, model, total, tally=tally)
            own += total["emit"][: near.near + 1]
            held.append((hashes, total.pop("emit")[near.near + 1 :]))
            if sum(len(h) for h, _ in held) > FAR_HELD:
                held = [merged(held)]
                if len(held[0][0]) > FAR_HELD // 2:
                    yield words(*held.pop())
            trim()
        if held:
            yield words(*merged(held))
        by_rank = np.empty(near.near, np.uint64)
        by_rank[near.rank] = near.hashes
        yield words(by_rank, own[:-1])
        meta = np.concatenate([total["start"], (total["move"] * model.move).ravel(), own[-1]])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(meta), pa.int64()), *[pa.nulls(len(meta), pa.float32())] * s, pa.array(np.arange(len(meta)), pa.int32()), pa.array(meta)], ["hash", *columns, "at", "v"])
        trim()

    sums = [F.sum(c).alias(c) for c in [*columns, "v"]]
    return rows.select("ids", "far").mapInArrow(run, schema).groupBy("hash", "at").agg(*sums)


@dataclass
class Emissions:
    """What the scoring tasks hold of the emissions: factors of words' codes, the rest's and the end's; a word of
    count n and a code has, in state k, (n + 1) * own[k] * 2 ** ((code[k] - ZERO) / STEP)."""

    own: np.ndarray
    rest: np.ndarray  # of one whose class is the rest, to be multiplied by its count and 1
    end: np.ndarray

    def of(self, n: np.ndarray, code: np.ndarray) -> np.ndarray:
        """n is 0 for words that training never saw; these and rare words are of the rest."""
        s = len(self.own)
        codes = np.ascontiguousarray(code, "<i8").view(np.uint8).reshape(-1, 8)[:, :s].astype(float)
        own = self.own * 2.0 ** ((codes - ZERO) / STEP)
        return (n[:, None] + 1.0) * np.where((n >= LEAST_OWN)[:, None], own, self.rest)


def all_words(counts: DataFrame, found: DataFrame, v: Vocabulary, states: int) -> tuple[Model, Emissions, DataFrame]:
    """The last round's model: start and moves, the factors of emissions, and rows (hash, n, code) of all words.

    A word's share in a state is its plain one times a ratio, kept in 8 bits on a scale of logarithms. The
    factors make each state's shares sum to one just as they are kept.
    """
    columns = [f"c{k}" for k in range(states)]
    meta = {r["at"]: r["v"] for r in found.where("at is not null").select("at", "v").collect()}
    meta = np.array([meta.get(i, 0.0) for i in range(states * (states + 2))])
    start, move, end = meta[:states], meta[states : states * (states + 1)].reshape(states, states), meta[states * (states + 1) :]
    sums = found.where("hash is not null").select("hash", *columns)
    rare = F.col("n") < LEAST_OWN
    part = lambda of, c, name: F.coalesce(F.sum(F.when(of, c)), F.lit(0.0)).alias(name)
    words, seen = materialize(
        counts.join(sums, "hash", "left").fillna(0.0, columns), part(~rare, F.col("n") + 1.0, "own_weight"),
        *[part(rare, F.col(c), f"rest_{c}") for c in columns], *[part(~rare, F.col(c), f"own_{c}") for c in columns],
    )
    rest_weight = v.total - seen["own_weight"] - v.end_weight
    rest_count, own_count = (np.array([seen[f"{n}_{c}"] for c in columns]) for n in ("rest", "own"))
    whole = rest_count + own_count + end + SMOOTH
    rest = (rest_count + SMOOTH * rest_weight / v.total) / whole
    last = (end + SMOOTH * v.end_weight / v.total) / whole if v.ends else np.zeros(states)
    if not own_count.any() and not v.ends:
        rest = np.ones(states)
    share = (F.col("n") + 1.0) / float(v.total)
    code = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        ratio = (F.col(c) + SMOOTH * share) / (float(whole[k]) * share)
        each = F.least(F.greatest(F.round(F.log2(ratio) * STEP + ZERO), F.lit(0)), F.lit(255)).cast("long")
        code = code.bitwiseOR(F.shiftleft(each, 8 * k))
    kept = lambda k: F.pow(F.lit(2.0), (F.shiftrightunsigned("code", 8 * k).bitwiseAND(255) - ZERO) / float(STEP))
    coded, norm = materialize(words.select("hash", "n", F.when(rare, F.lit(0).cast("long")).otherwise(code).alias("code")), *[part(~rare, (F.col("n") + 1.0) * kept(k), f"z{k}") for k in range(states)])
    dropped(words)
    z = np.array([norm[f"z{k}"] for k in range(states)])
    own = np.where(z > 0, (1 - rest - last) / np.maximum(z, 1e-300), 0.0)
    return Model(*chain(start, move), np.zeros((0, states))), Emissions(own, rest / max(1, rest_weight), last if v.ends else rest / max(1, rest_weight)), coded


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, near: int = NEAR, lead: int = LEAD) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one a row of ``docs``.

    The model learns from documents whose crc32(doc_id as text) mod 7 is not 2, all of them in every round;
    its vocabulary counts are exact. The first rounds tie words beyond the ``lead`` most frequent to each other; the
    last one gathers the expected counts of every word, and in the model each word of two or more occurrences has
    emissions of its own, however many words there are. Words of one occurrence are a class, within which a word has
    its add-one share, and one share stands for all words that training never saw. So a text's
    probabilities sum to one, and ``score`` is the log10 of what the forward recursion gives for the whole text.

    Tasks hold the ``near`` most frequent words' numbers; those of others come to a text by a join on the word. A
    null or empty text is its end alone; a null id counts as the empty text in the split; repeated rows
    each count and are scored; words of one count (ties) are ranked by hash; other columns are ignored; without
    training documents every token has probability 1 in both scores; an empty table gives no row.
    """
    if not 1 <= states <= 8:
        raise ValueError("1 to 8 states")
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col("doc_id")))
    n = F.col("n")
    counts, seen = materialize(word_counts(training), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.count(n).alias("types"))
    v = vocabulary(counts, seen["tokens"], seen["types"], training.select("doc_id").count(), near, lead)
    shared = spark.sparkContext.broadcast(v)
    rows = materialize(encoded(docs, shared))
    learn = rows.where("not held_out")
    plain = v.plain()
    m = first_model(company(learn, min(SEEDS, v.lead)) if v.lead else np.zeros((0, 0)), plain, states)
    for _ in range(rounds - 1):
        m = baum_welch(learn, m, plain, v)
    found = materialize(gathered(learn, m, v))
    m, emissions, coded = all_words(counts, found, v, states)
    dropped(found, counts)
    top = coded.where(n >= v.least).toPandas()
    codes = np.zeros(v.near, np.int64)
    codes[v.rank] = top.sort_values("hash", key=lambda h: h.to_numpy(np.int64).view(np.uint64))["code"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast((m, emissions, np.concatenate([emissions.of(v.counts, codes), emissions.end[None]]), np.append(np.log10(v.counts + 1.0), np.log10(v.ends + 1.0)), int(v.ends > 0)))

    met = rows.select("row", F.posexplode("far").alias("pos", "hash")).join(coded, "hash").groupBy("row").agg(F.collect_list(F.struct("pos", "n", "code")).alias("met"))
    texts = rows.select("row", "doc_id", "held_out", "n_words", "ids", F.size("far").alias("far")).join(met, "row", "left")
    texts = texts.withColumn("met", F.coalesce("met", F.array().cast("array<struct<pos:int,n:long,code:long>>")))

    def forward(batch: pa.RecordBatch) -> dict:
        model, emit, table, logs, known_end = held.value
        get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        ids, off = flat_lists(get["ids"])
        sizes = get["far"].to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        count, code = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), np.int64)
        at = get["met"].offsets.to_numpy().astype(np.int64)
        flat = get["met"].values.slice(int(at[0]), int(at[-1] - at[0]))
        place = np.repeat(first, np.diff(at)) + flat.field(0).to_numpy()
        count[place], code[place] = flat.field(1).to_numpy(), flat.field(2).to_numpy()
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        end = len(table) - 1
        line = np.where(ids > end, ids + first[text], ids)
        all_logs = np.concatenate([logs, np.log10(count + 1.0)])
        is_known = np.concatenate([np.ones(end), [known_end], count > 0])
        whole = Model(model.start, model.move, np.concatenate([table, emit.of(count, code)]))
        out = [log_likelihoods(line, off[lo : lo + 2001], whole) for lo in range(0, len(off) - 1, 2000)]
        per = lambda w: np.bincount(text, weights=w[line], minlength=len(off) - 1)
        return {
            "doc_id": get["doc_id"], "held_out": get["held_out"], "n_tokens": np.diff(off), "n_known": per(is_known).astype(np.int64),
            "train_tokens": np.full(len(off) - 1, v_tokens), "base_score": per(all_logs) - np.diff(off) * log_total, "score": np.concatenate(out),
        }

    v_tokens, log_total = int(v.tokens), float(np.log10(v.total))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_arrow(texts.select("doc_id", "held_out", "ids", "far", "met"), forward, schema)
