"""Packing documents into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import as_arrow, lists, map_arrow, materialize
from tiltyard.llm.tokens import TokenizerFile


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: Karmarkar-Karp with ``windows`` parts.

    Each item begins as a partial partition of itself and empty windows. The two of the largest imbalance
    are merged, the fullest window of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    if windows <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    # A partial partition: its filled windows' sums, descending, and the trees of what is in them.
    heap = [(-int(s), i, np.array([s], np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # tree n + j is of these two
    order = n
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - windows)  # a's last windows take b's last ones, smallest with largest
        sums = np.concatenate([a[: len(a) - meet], a[len(a) - meet :] + b[len(b) - meet :][::-1], b[: len(b) - meet]])
        trees = ta[: len(a) - meet]
        for x, y in zip(ta[len(a) - meet :], tb[len(b) - meet :][::-1]):
            joined.append((x, y))
            trees.append(n + len(joined) - 1)
        trees += tb[: len(b) - meet]
        by = np.argsort(-sums, kind="stable")
        sums, trees = sums[by], [trees[i] for i in by]
        low = int(sums[-1]) if len(sums) == windows else 0
        order += 1
        heapq.heappush(heap, (low - int(sums[0]), order, sums, trees))
    out = np.empty(n, np.int64)
    for w, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = w
            else:
                todo += joined[x - n]
    return out


def fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The fewest windows, from the total's quotient up, whose differencing exceeds no capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, windows)
        over = int(np.bincount(at, weights=sizes).max(initial=0)) - capacity
        if over <= 0:
            return at
        windows += max(1, over * windows // capacity)


def pieces(n: int, capacity: int, filler: int = 8, whole: int = 200) -> list[tuple[int, int]]:
    """Cuts of n ids: full windows first; the rest, if over ``whole`` ids, into a large piece and its last
    ``filler``-th. Differencing evens windows out as finely as its small items allow."""
    full, rest = divmod(n, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    small = rest // filler if rest > whole else 0
    return out + [(at, size) for at, size in ((full * capacity, rest - small), (n - small, small)) if size]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, filler: int = 8, block: int = 256, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids``
    the piece's token ids.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Full windows of a
    long document are sequences of their own. The other pieces are dealt by hash into blocks of about
    ``block`` sequences, however many documents there are, and each block is packed by differencing into the
    fewest windows that hold it. Each row of ``docs`` is a document, so repeated rows and null ids are packed
    each time they occur; pieces of one length (ties) go by their rows' numbers; other columns are ignored; an empty
    table gives no row.
    """
    file = TokenizerFile(docs, tokenizer)

    def encode(batch: pa.RecordBatch) -> dict:
        of, rows, kept = file.encoder(), [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            own = np.append(of.ids(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
            for start, size in pieces(len(own), capacity, filler):
                part = own[start : start + size]
                rows.append((row, start, size, zlib.crc32(part.tobytes()), len(own)))
                if ids:
                    kept.append(part)
        at = np.array(rows, np.int64).reshape(-1, 5)
        out = {"doc_id": batch.column(0).take(pa.array(at[:, 0])), "start": at[:, 1], "length": at[:, 2], "ids_crc32": at[:, 3], "doc_tokens": at[:, 4]}
        if ids:
            out["ids"] = lists(np.concatenate(kept).astype(np.int32), at[:, 2], pa.int32())
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    open_tokens = F.coalesce(F.sum(F.when(F.col("length") < capacity, F.col("length"))), F.lit(0)).alias("t")
    cut, seen = materialize(map_arrow(docs.select("doc_id", "text"), encode, schema).withColumn("row", F.monotonically_increasing_id()), open_tokens)
    blocks = max(1, -(-seen["t"] // (block * capacity)))
    full = cut.where(F.col("length") == capacity).select("*", F.lit(0).cast("long").alias("offset"), F.col("row").alias("sequence_id"))
    open_ = cut.where(F.col("length") < capacity).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def solve(batch: pa.Table) -> pa.Table:
        order = np.lexsort((batch["row"].to_numpy(), -batch["length"].to_numpy()))
        batch = batch.take(pa.array(order))
        size = batch["length"].to_numpy().astype(np.int64)
        at = fit(size, capacity)
        by = np.argsort(at, kind="stable")
        batch, size, at = batch.take(pa.array(by)), size[by], at[by]
        before = np.cumsum(size) - size
        first = np.searchsorted(at, at)
        # rows of full windows have ids under 2**62; those of blocks come after
        sequence = (np.int64(1) << np.int64(62)) + batch["block"].to_numpy().astype(np.int64) * (1 << 24) + at
        batch = batch.drop_columns(["block"])
        return batch.append_column("offset", as_arrow(before - before[first], pa.int64())).append_column("sequence_id", as_arrow(sequence, pa.int64()))

    packed = open_.groupBy("block").applyInArrow(solve, full.schema)
    out = full.unionByName(packed)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else []))
