"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one a shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import components, dropped, join_by_count, local_stars, materialize, mix, trim

COSINE = 0.95
LINKS = 16  # of a node in an upper layer; twice as many in the lowest
BEAM = 32  # entries of a search's beam to begin with
SHARD_BYTES = 32 << 20  # of a shard's vectors in single precision, which so always fit a task; more make more shards
LEAST_SHARDS = 6
QUERIES = 1 << 17  # of a task at most
#: Of each task's queries so many that have links, and so many others, are held against brute force; what share of their links must be found.
AUDITED, OTHERS, RECALL = 256, 32, 1.0
CHUNK = 1 << 22  # cosines of a block in brute force, and links held at once


def beam_search(x: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, each: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For many queries in step: the best ``width`` nodes found and their cosines, descending.

    Every step expands each query's best few nodes that are in its beam and not expanded yet; a query is done
    when there is none.
    """
    b, n = len(queries), len(x)
    width = min(width, n)
    seen = np.zeros((b, n), bool)
    beam = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    k = min(entry.shape[1], width)
    beam[:, :k] = entry[:, :k]
    sims[:, :k] = np.einsum("bkd,bd->bk", x[entry[:, :k]], queries)
    done[:, :k] = False
    np.put_along_axis(seen, entry[:, :k].astype(np.int64), True, axis=1)
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argsort(-open_, axis=1)[:, :each]
        has = np.take_along_axis(open_, pick, axis=1) > -np.inf
        keep = has[:, 0]
        live, pick, has = live[keep], pick[keep], has[keep]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] = True
        new = np.where(has[:, :, None], near[beam[rows, pick]], -1).reshape(len(live), -1)
        fresh = (new >= 0) & ~seen[rows, new]
        seen[np.repeat(live, new.shape[1])[fresh.ravel()], new[fresh]] = True
        order = np.argsort(np.where(fresh, new, n), axis=1, kind="stable")  # two expanded nodes may share one
        new, fresh = np.take_along_axis(new, order, axis=1), np.take_along_axis(fresh, order, axis=1)
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        most = max(1, int(fresh.sum(axis=1).max()))
        first = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        new, fresh = np.take_along_axis(new, first, axis=1), np.take_along_axis(fresh, first, axis=1)
        got = np.where(fresh, np.einsum("bkd,bd->bk", x[new], queries[live]), -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[live], got], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, best, axis=1)
        beam[live] = np.take_along_axis(np.concatenate([beam[live], new], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(beam, order, axis=1), np.take_along_axis(sims, order, axis=1)


def diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """For each node its neighbours out of candidates: the nearest first, each only if no one chosen before is
    nearer to it than the node is; places that are left go to the nearest of the others."""
    sims = np.where(cand >= 0, np.einsum("bkd,bd->bk", x[cand], x[own]), -np.inf)
    sims[cand == own[:, None]] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
    same = np.zeros(cand.shape, bool)
    for j in range(1, cand.shape[1]):
        same[:, j] = (cand[:, :j] == cand[:, j : j + 1]).any(axis=1)
    sims[same] = -np.inf
    each = x[cand]
    worst = np.full(cand.shape, -np.inf)  # each candidate's cosine to the nearest chosen
    chosen = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        take = (sims[:, j] > worst[:, j]) & (sims[:, j] > -np.inf) & (chosen.sum(axis=1) < most)
        chosen[:, j] = take
        if take.any():
            to = np.einsum("bkd,bd->bk", each[take], each[take, j])
            worst[take] = np.maximum(worst[take], to)
    rank = np.where(chosen, 0, np.where(sims > -np.inf, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
    pick = np.argsort(rank, axis=1)[:, :most]
    out = np.where(np.take_along_axis(sims, pick, axis=1) > -np.inf, np.take_along_axis(cand, pick, axis=1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def layer(x: np.ndarray, most: int, entries, width: int = 48) -> np.ndarray:
    """The neighbours in one layer of all of ``x``: brute force for the first nodes, then batch after batch is
    searched for in what is there, from ``entries`` (places of the layer above), and linked both ways."""
    n = len(x)
    near = np.full((n, most), -1, np.int32)
    lo = 0
    while lo < n:
        hi = min(n, max(1024, lo + min(2048, lo // 2)))
        own = np.arange(lo, hi)
        inside = x[lo:hi] @ x[lo:hi].T
        np.fill_diagonal(inside, -np.inf)
        k = min(width, len(own))
        cand = own[np.argpartition(-inside, k - 1, axis=1)[:, :k]] if len(own) > 1 else np.full((1, 1), -1)
        if lo:
            found = [beam_search(x[:lo], near[:lo], x[p], entries(x[p], lo), width)[0] for p in np.array_split(own, -(-len(own) // 512))]
            cand = np.concatenate([cand, np.concatenate(found)], axis=1)
        near[lo:hi] = diverse(x, own, cand, most)
        a, b = np.repeat(own, most), near[lo:hi].ravel()  # and back
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        place = np.arange(len(b)) - np.searchsorted(b, b)
        room = min(int(place.max(initial=0)) + 1, 4 * most)
        to = np.unique(b)
        back = np.full((len(to), room), -1, np.int64)
        at = np.searchsorted(to, b)
        few = place < room
        back[at[few], place[few]] = a[few]
        for p in np.array_split(np.arange(len(to)), -(-len(to) // 2048) or 1):
            if len(p):
                near[to[p]] = diverse(x, to[p], np.concatenate([near[to[p]], back[p]], axis=1), most)
        lo = hi
    return near


def levels(ids: np.ndarray) -> np.ndarray:
    """The top layer of each node, by its hash: one in ``LINKS`` goes a layer higher."""
    h = mix(ids.astype(np.uint64) + np.uint64(77))
    return np.floor(np.log2(LINKS) ** -1 * -np.log2(((h >> np.uint64(11)).astype(float) + 1) / 2**53)).astype(int)


class Graph:
    """A shard's layers, the highest first. Nodes are in descending order of their level, so that a layer is a prefix
    of them."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def built(cls, ids: np.ndarray, x: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph, and which of ``ids`` each of its nodes is."""
        top = levels(ids)
        order = np.lexsort((mix(ids.astype(np.uint64)), -top))
        top = top[order]
        graph = cls(np.ascontiguousarray(x[order], np.float32), [])
        sizes = [int((top >= level).sum()) for level in range(int(top.max(initial=0)) + 1)]
        while len(sizes) > 1 and sizes[-2] <= 64:
            sizes.pop()
        for level in range(len(sizes) - 1, -1, -1):
            graph.layers.append(layer(graph.x[: sizes[level]], LINKS if level else 2 * LINKS, graph._entries))
        graph._reach_all()
        return graph, order

    def _reach_all(self) -> None:
        """Pruning may leave nodes of the lowest layer without a way to them: each such island gets a link from
        the nearest node that can be reached."""
        near, n = self.layers[-1], len(self.x)
        while True:
            seen = np.zeros(n, bool)
            front = np.zeros(1, np.int64)
            while len(front):
                seen[front] = True
                to = np.unique(near[front])
                to = to[to >= 0]
                front = to[~seen[to]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            inside = np.unique(near[lost])
            heads = np.setdiff1d(lost, inside) if len(np.setdiff1d(lost, inside)) else lost[:1]
            known = np.flatnonzero(seen)
            extra = np.full((n, 1), -1, np.int32)
            for part in np.array_split(heads, -(-len(heads) // 256)):
                at = known[(self.x[part] @ self.x[known].T).argmax(axis=1)] if len(known) * len(part) < 1 << 25 else beam_search(self.x, near, self.x[part], self.enter(self.x[part], -1), BEAM)[0][:, 0]
                extra[at, 0] = part  # of several for one node the last; the others' turn comes next
            near = np.concatenate([near, extra], axis=1)
        self.layers[-1] = near

    def _entries(self, queries: np.ndarray, below: int) -> np.ndarray:
        """Where to enter the layer that is being made, of whose nodes the first ``below`` are linked."""
        return np.minimum(self.enter(queries), below - 1) if self.layers else np.zeros((len(queries), 1), np.int64)

    def enter(self, queries: np.ndarray, upper: int | None = None) -> np.ndarray:
        at = np.zeros((len(queries), 1), np.int64)
        for near in self.layers[:upper]:
            n = len(near)
            at = beam_search(self.x[:n], near, queries, at, 4)[0][:, :4].astype(np.int64)
            at = np.where(at < 0, at[:, :1], at)
        return at[:, :1]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.x, self.layers[-1], queries, self.enter(queries, -1), width)

    def within(self, queries: np.ndarray, least: float, width: int):
        """Pairs (query, node) of a cosine of at least ``least``, some at a time. A query whose beam is all of such
        nodes has more than the beam holds, and is held against the whole shard."""
        full = []
        for lo in range(0, len(queries), step := max(8, (1 << 20) // max(width, 4096))):
            part = np.arange(lo, min(lo + step, len(queries)))
            beam, sims = self.search(queries[part], width)
            over = (sims[:, -1] >= least) & (width < len(self.x))
            r, c = np.nonzero((sims >= least) & ~over[:, None])
            yield part[r], beam[r, c]
            full.append(part[over])
        rest = np.concatenate(full) if full else np.zeros(0, np.int64)
        for lo in range(0, len(rest), step := max(1, CHUNK // len(self.x))):
            part = rest[lo : lo + step]
            r, c = np.nonzero(queries[part] @ self.x.T >= least)
            yield part[r], c


def unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    v = column.combine_chunks().flatten().to_numpy().reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def built_shard(nodes: pa.Table) -> pa.Table:
    """A shard's nodes in their graph's order, each with its neighbours in every layer it is in, the lowest first."""
    dim = nodes["dim"][0].as_py()
    graph, order = Graph.built(nodes["node"].to_numpy(), unit(nodes["vector"], dim))
    near: list[list] = [[row[row >= 0]] for row in graph.layers[-1]]
    for upper in reversed(graph.layers[:-1]):
        for i, row in enumerate(upper):
            near[i].append(row[row >= 0])
    trim()
    out = nodes.take(pa.array(order))
    return out.append_column("place", pa.array(np.arange(len(order)), pa.int32())).append_column("near", pa.array(near, pa.list_(pa.list_(pa.int32()))))


def restored(index: pa.Table, x: np.ndarray) -> Graph:
    """The graph of a shard's rows, in order."""
    column = index["near"].combine_chunks()
    depth = np.diff(column.offsets.to_numpy())
    lists_ = column.flatten()
    sizes, values = np.diff(lists_.offsets.to_numpy()), lists_.flatten().to_numpy()
    begins = np.cumsum(sizes) - sizes
    first = np.cumsum(depth) - depth
    layers = []
    for level in range(int(depth.max())):
        at = first[depth > level] + level  # a layer is a prefix of the nodes
        own = sizes[at]
        near = np.full((len(at), max(1, int(own.max()))), -1, np.int32)
        line = np.repeat(np.arange(len(at)), own)
        place = np.arange(len(line)) - np.repeat(np.cumsum(own) - own, own)
        near[line, place] = values[np.repeat(begins[at], own) + place]
        layers.append(near)
    return Graph(x.astype(np.float32), layers[::-1])


def shard_links(index: pa.Table, queries: pa.Table) -> pa.Table:
    """What one shard tells some queries: for each its links' number (a, n), edges (a, b) that connect what links do,
    and one row of the audit: the links that the audited queries have, how many were found, and the beam.

    Audited are queries for which links were found, and a few others; their truth is brute force, themselves left
    out. While they find less than ``RECALL`` of it, all beams widen, in the end to the whole shard. What is found is
    confirmed in double precision.
    """
    kinds = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "true_pairs": pa.int64(), "found_pairs": pa.int64(), "beam": pa.int64()}
    made = lambda size, **of: pa.table({k: pa.array(of[k], kinds[k]) if k in of else pa.nulls(size, kinds[k]) for k in kinds})
    if not index.num_rows or not queries.num_rows:
        return made(0)
    index = index.sort_by("place")
    dim = index["dim"][0].as_py()
    ids, copies, x = index["node"].to_numpy(), index["copies"].to_numpy(), unit(index["vector"], dim)
    q_ids, q = queries["node"].to_numpy(), unit(queries["vector"], dim)
    graph, fast, width = restored(index, x), q.astype(np.float32), BEAM
    by_hash = np.argsort(mix(q_ids.astype(np.uint64) + np.uint64(5)))
    truth = audit = None
    while True:
        n = np.zeros(len(q_ids), np.int64)
        stars, held = [], 0
        found = None if audit is None else np.zeros(truth.shape, bool)
        place = None if audit is None else np.full(len(q_ids), -1)
        if audit is not None:
            place[audit] = np.arange(len(audit))
        for a, b in graph.within(fast, COSINE - 1e-4, width):
            keep = q_ids[a] != ids[b]
            a, b = a[keep], b[keep]
            keep = np.zeros(len(a), bool)
            for lo in range(0, len(a), 1 << 16):
                p = slice(lo, lo + (1 << 16))
                keep[p] = np.einsum("kd,kd->k", q[a[p]], x[b[p]]) >= COSINE
            a, b = a[keep], b[keep]
            n += np.bincount(a, weights=copies[b], minlength=len(q_ids)).astype(np.int64)
            if audit is not None:
                seen = place[a] >= 0
                found[place[a[seen]], b[seen]] = True
            stars.append((np.maximum(q_ids[a], ids[b]), np.minimum(q_ids[a], ids[b])))
            held += len(a)
            if held > CHUNK:
                stars = [local_stars(*map(np.concatenate, zip(*stars)))]
                held = len(stars[0][0])
        if audit is None:
            linked = by_hash[n[by_hash] > 0]
            audit = np.unique(np.concatenate([linked[:AUDITED], by_hash[n[by_hash] == 0][:OTHERS]]))
            truth = np.concatenate([q[audit[lo : lo + 16]] @ x.T >= COSINE for lo in range(0, len(audit), 16)]) & (q_ids[audit][:, None] != ids)
            got = graph.within(fast[audit], COSINE - 1e-4, width)
            found = np.zeros(truth.shape, bool)
            for a, b in got:
                found[a, b] = True
        met = int((found & truth).sum())
        if met >= RECALL * truth.sum() or width >= len(ids):
            break
        width *= 2
    some = np.flatnonzero(n)
    u, v = local_stars(*map(np.concatenate, zip(*stars))) if stars else (np.zeros(0, np.int64),) * 2
    trim()
    return pa.concat_tables([
        made(len(some), a=q_ids[some], n=n[some]), made(len(u), a=u, b=v), made(1, true_pairs=[int(truth.sum())], found_pairs=[met], beam=[width]),
    ])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept, recall), one a row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine, in double precision, is at least 0.95. Equal vectors are one node
    with a number of copies. Nodes are dealt by hash to shards, each with a graph that is built once and written;
    every node is looked for in every shard, and components come from all links. ``recall`` is the least share that
    any task's audited queries found of their links, the same in all rows and null where none has a link. Vectors
    that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do those of different
    lengths with each other. Rows with a null id are vectors like others; a component's id is its least id that isn't
    null. Repeated rows link with each other. A cosine of just 0.95 (a tie) is a link. Other columns are ignored; an
    empty table gives no row.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", e.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("good", good).withColumn("h1", F.when(F.col("good"), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(7), "vector")))
    nodes = rows.where("good").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    nodes, seen = materialize(
        nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")),
        F.count(F.lit(1)).alias("n"), zero(F.sum(F.size("vector").cast("long")), "numbers"), zero(F.sum("copies"), "rows"),
    )
    shards = max(LEAST_SHARDS, -(-4 * seen["numbers"] // SHARD_BYTES))
    blocks = max(2, -(-seen["n"] // QUERIES))
    of = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(n)).cast("int")
    dealt = nodes.select("dim", of("shard", shards).alias("shard"), "node", "copies", "vector")
    graphs = materialize(dealt.groupBy("dim", "shard").applyInArrow(built_shard, "dim int, shard int, node long, copies long, vector array<double>, place int, near array<array<int>>"))
    index = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = nodes.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), of("block", blocks).alias("block"), "node", "vector")
    keys = ["dim", "shard", "block"]
    found, audit = materialize(
        index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(shard_links, "a long, b long, n long, true_pairs long, found_pairs long, beam long"),
        F.min(F.when(F.col("true_pairs") > 0, F.col("found_pairs") / F.col("true_pairs"))).alias("recall"),
    )
    dropped(graphs)
    links = found.where("n is not null").groupBy(F.col("a").alias("l_node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("id").alias("r_node"), "root")
    joined = nodes.join(links, F.col("node") == F.col("l_node"), "left").join(roots, F.col("node") == F.col("r_node"), "left")
    joined = joined.select("h1", "h2", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    name = joined.groupBy(F.col("root").alias("n_root")).agg(F.min("least").alias("component"))
    joined = joined.join(name, F.col("root") == F.col("n_root"))
    known = joined.select("h1", "h2", "copies", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component")
    out = join_by_count(rows.select("vec_id", F.coalesce("h1", F.lit(0)).alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2")), known, ["h1", "h2"], "copies", seen["rows"])
    component = F.coalesce("component", "vec_id")
    recall = F.lit(None if audit["recall"] is None else float(audit["recall"])).cast("double").alias("recall")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), recall)
