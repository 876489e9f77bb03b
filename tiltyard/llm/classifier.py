"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import Chunk, chunks, lists, map_arrow, mix, numbered
from tiltyard.llm.hmm import summed

#: The network learns from at most so many labelled documents, those with the least hash of their id.
LABELLED_ROWS = 20_000
SIZE = 64  # of a word vector and of an index vector
BUCKETS = 1 << 14  # words share vectors by hash
NEAR = 2  # a word's company: so many words on either side
HIDDEN = 32
CUT = 0.7


def held_out(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def index_vectors(n: int, seed: int, size: int = SIZE, filled: int = 6) -> np.ndarray:
    """Fixed sparse vectors of a few 1 and -1 each."""
    at = numbered(n * filled, seed).reshape(n, filled)
    out = np.zeros((n, size), np.float32)
    np.add.at(out, (np.arange(n)[:, None], (mix(at) % np.uint64(size)).astype(int)), np.where(mix(at + np.uint64(2)) & np.uint64(1), 1, -1))
    return out


_WORD_INDEX, _BYTE_INDEX = index_vectors(BUCKETS, 21), index_vectors(256, 22)


def buckets(part: Chunk) -> np.ndarray:
    return (part.hashes() % np.uint64(BUCKETS)).astype(np.int64)


def word_index(part: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index vectors of a chunk's different words, each word's own and its bytes' mean; the bucket of each; and
    which of them every word is."""
    hashes, first, which = np.unique(part.hashes(), return_index=True, return_inverse=True)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    start, size = part.start[first], part.end[first] - part.start[first]
    before = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(start - before, size)
    own = np.add.reduceat(_BYTE_INDEX[part.data[at]], before, axis=0) / size[:, None].astype(np.float32) if len(hashes) else np.zeros((0, SIZE), np.float32)
    return own + _WORD_INDEX[bucket], bucket, which


def context_vectors(texts: DataFrame) -> np.ndarray:
    """Random indexing: a word's vector is the sum of the index vectors of the words near it, wherever it occurs,
    less what as many words' company is in the mean, brought to length one."""

    def count(batches):
        total = np.zeros((BUCKETS, SIZE + 1))  # and how often a word occurs
        for batch in batches:
            for part in chunks(batch.column(0), limit=1 << 17):
                if not len(part.start):
                    continue
                index, bucket, which = word_index(part)
                # Texts stand apart by as many empty places as a word's company reaches.
                place = np.arange(len(which)) + NEAR * part.doc
                line = np.full(len(which) + NEAR * (part.n + 1) + NEAR, len(index))
                line[place + NEAR] = which
                own = np.concatenate([index, np.zeros((1, SIZE), np.float32)])[line]
                size = len(line) - 2 * NEAR
                near = np.zeros((size, SIZE + 1), np.float32)
                for k in range(2 * NEAR + 1):
                    if k != NEAR:
                        near[:, :SIZE] += own[k : k + size]
                near[:, SIZE] = 1
                of = bucket[which]
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.diff(of[order], prepend=-1))
                total[of[order][first]] += np.add.reduceat(near[place[order]], first, axis=0)
        for b in range(0, BUCKETS, 64):
            yield b, total[b : b + 64].ravel()

    got = summed(texts.select("text"), count)
    total = np.zeros((BUCKETS, SIZE + 1))
    for b, values in got.items():
        total[b : b + 64] = values.reshape(-1, SIZE + 1)
    company, n = total[:, :SIZE], total[:, SIZE:]
    company = company - n * (company.sum(axis=0) / max(1.0, n.sum()))
    return (company / np.maximum(np.linalg.norm(company, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * SIZE + 4


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A document's features: its word vectors' mean and deviation, how alike neighbours are, the mean's length, and
    the numbers of words and bytes."""
    out = []
    for part in chunks(column, limit=1 << 18):
        word = vectors[buckets(part)]
        values = np.zeros((part.n, FEATURES), np.float32)
        some = part.n_words > 0
        if some.any():
            first, n = part.bounds[:-1][some], part.n_words[some][:, None]
            mean = np.add.reduceat(word, first, axis=0) / n
            alike = np.zeros(len(word), np.float32)
            alike[1:] = np.einsum("ij,ij->i", word[1:], word[:-1]) * (part.doc[1:] == part.doc[:-1])
            values[some, :SIZE] = mean
            values[some, SIZE : 2 * SIZE] = np.sqrt(np.maximum(np.add.reduceat(word * word, first, axis=0) / n - mean * mean, 0))
            values[some, -4] = np.add.reduceat(alike, first) / n[:, 0]
            values[some, -3] = np.linalg.norm(mean, axis=1)
        values[:, -2] = np.log1p(part.n_words) / 5
        values[:, -1] = np.log1p(np.diff(part.offsets)) / 8
        out.append(values)
    return np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 11) -> Network:
    """Adam on four fifths of the rows; the temperature is the one of least log loss on the others."""
    rng = np.random.default_rng(seed)
    fits = np.arange(len(y)) % 5 != 4
    net = Network(x[fits].mean(axis=0), x[fits].std(axis=0) + 1e-3, [])
    dims = (x.shape[1], HIDDEN, 1)
    weights = [w for a, b in zip(dims, dims[1:]) for w in (rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b))]
    xs, ys = (x[fits] - net.mean) / net.scale, y[fits].astype(float)[:, None]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 128)):
            w1, b1, w2, b2 = weights
            h = np.tanh(xs[part] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60)))
            out = (p - ys[part]) / len(part)
            back = out @ w2.T * (1 - h * h)
            grads = [xs[part].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ out + 1e-4 * w2, out.sum(axis=0)]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.layers = [(weights[0], weights[1]), (weights[2], weights[3])]
    if (~fits).any():
        z, t = net.logits(x[~fits]), y[~fits].astype(float)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.mean(np.logaddexp(0, -z / g) * t + np.logaddexp(0, z / g) * (1 - t)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def classify(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one a row of ``docs``: how likely ``quality`` is 1.

    Only texts enter a score. Word vectors come from all documents whose crc32(doc_id as text) mod 4 is not 2; the
    network learns from at most ``rows`` labelled ones of these, where ids repeat and labels meet more documents too.
    A null or empty text has no words, its pooled vectors are zero and it is scored as such. Without labels, or
    with one class alone, every score is the classes' smoothed share. Null ids count as the empty text in the split
    and repeated rows each are scored; a score of just 0.7 is predicted 1; ids of one hash (ties) are ordered by id
    and features; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    learns = ~held_out(F.col("doc_id"))
    vectors = spark.sparkContext.broadcast(context_vectors(docs.where(learns)))
    chosen = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learns)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batch: pa.RecordBatch) -> dict:
        x = pooled(batch.column(2), vectors.value)
        return {"doc_id": batch.column(0), "quality": batch.column(1), "x": lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float32())}

    seen = map_arrow(known.select("doc_id", "quality", "text"), features, "doc_id long, quality long, x array<float>")
    # A limit under an order keeps each partition's least rows only: what comes to the driver is bounded.
    got = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(rows).toPandas()
    got["hash"] = mix(got["doc_id"].to_numpy().astype(np.uint64)) if len(got) else []
    got = got.sort_values(["hash", "quality"], kind="stable")
    y = got["quality"].to_numpy() == 1 if len(got) else np.zeros(0, bool)
    learned = train(np.stack(got["x"].to_list()).astype(float), y) if 0 < y.sum() < len(y) else None
    share = (y.sum() + 1) / (len(y) + 2)
    model = spark.sparkContext.broadcast((learned, share))

    def score(batch: pa.RecordBatch) -> dict:
        net, prior = model.value
        p = net.probability(pooled(batch.column(2), vectors.value)) if net else np.full(batch.num_rows, prior)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": p, "predicted": (p >= CUT).astype(np.int32)}

    return map_arrow(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), score, "doc_id long, held_out boolean, score double, predicted int")
