import numpy as np

from tiltyard.llm import hnsw
from tiltyard.llm.queries import queries


def brute(ids, vectors):
    x = np.full((len(ids), max((len(v) for v in vectors if v), default=1)), np.nan)
    ok = np.zeros(len(ids), bool)
    for i, v in enumerate(vectors):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            own = np.array(v, float) / np.abs(np.array(v, float)).max()
            x[i, : len(v)], ok[i] = own / np.linalg.norm(own), True
    links = np.nan_to_num(x) @ np.nan_to_num(x).T >= 0.95
    links &= ok[:, None] & ok[None, :]
    np.fill_diagonal(links, False)
    low = np.array(ids)
    while True:
        new = low.copy()
        a, b = np.nonzero(links)
        np.minimum.at(new, a, low[b])
        if (new == low).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, links.sum(1), low)}
        low = new


def check(df, ids, vectors):
    got = hnsw.near_vectors(df).collect()
    assert len(got) == len(ids)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(ids, vectors)
    assert all(r.kept == (r.vec_id == r.component_id) and r.recall >= 0.9 for r in got)


def frame(spark, ids, vectors, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors)], f"vec_id long, embedding array<{kind}>, n_links int, node int")


def clusters(rng, n, groups, dim=16, noise=0.04):
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)]
    return x + noise * rng.normal(size=x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(dim)


def test_clusters_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = clusters(rng, 400, 60).tolist()
    vectors += [vectors[0]] * 20 + [[2 * c for c in vectors[1]]] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e300] + [0.0] * 15, [1e-300] + [0.0] * 15]
    ids = rng.permutation(10_000)[: len(vectors)].tolist()
    check(frame(spark, ids, vectors, "double"), ids, vectors)


def test_one_large_cluster(spark):
    """A third of all rows in one cluster: beams widen until they hold it."""
    rng = np.random.default_rng(2)
    vectors = np.concatenate([clusters(rng, 500, 1, noise=0.05), rng.normal(size=(900, 16))]).tolist()
    ids = list(range(len(vectors)))
    check(frame(spark, ids, vectors, "double"), ids, vectors)


def test_empty_lengths_and_null_ids(spark):
    assert hnsw.near_vectors(frame(spark, [], [])).count() == 0
    mixed = frame(spark, [1, 2, 3, None, 5], [[1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.01], [1.0, 0.0], None])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(mixed).collect()}
    assert got == {1: (2, 1, True), 2: (0, 2, True), 3: (2, 1, False), None: (2, 1, False), 5: (0, 5, True)}


def test_recall_of_one_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, _ = hnsw.Graph.built(np.arange(3000), x)
    q = x[:300] + 0.1 * rng.normal(size=(300, 24))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    beam, sims = g.search(q.astype(np.float32), 48)
    truth = np.argsort(-(q @ g.x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(beam.tolist(), truth.tolist())]) > 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    assert [len(layer) for layer in g.layers] == sorted(len(layer) for layer in g.layers)


def tables(rng, n, q, dim=12):
    import pyarrow as pa

    x = clusters(rng, n, n // 6, dim)
    nodes = pa.table({"dim": np.full(n, dim), "shard": np.zeros(n, int), "node": np.arange(n), "copies": np.ones(n, int), "vector": x.tolist()})
    return x, nodes, pa.table({"node": np.arange(q), "vector": x[:q].tolist()})


def test_a_written_graph_is_the_same():
    x, nodes, _ = tables(np.random.default_rng(5), 3000, 1)
    g, order = hnsw.Graph.built(np.arange(3000), hnsw.unit(nodes["vector"], 12))
    table = hnsw.built_shard(nodes)
    assert table["node"].to_numpy().tolist() == order.tolist()
    again = hnsw.restored(table, g.x)
    assert len(again.layers) == len(g.layers) > 1
    for a, b in zip(g.layers, again.layers):
        assert [set(r[r >= 0].tolist()) for r in a] == [set(r[r >= 0].tolist()) for r in b]


def test_the_audit_sees_missed_links(monkeypatch):
    """A graph without most of its links finds little: the audit notices and widens the beams until all is found."""
    x, nodes, queries_ = tables(np.random.default_rng(6), 2000, 400)
    table = hnsw.built_shard(nodes)
    whole = hnsw.shard_links(table, queries_).to_pandas()
    assert whole.true_pairs.sum() > 300 and whole.found_pairs.sum() == whole.true_pairs.sum()
    search = hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda g, q, width: tuple(np.where(np.arange(r.shape[1]) % 2 < (width > 100) + 1, r, -np.inf if r.dtype.kind == "f" else r) for r in search(g, q, width)))
    less = hnsw.shard_links(table, queries_).to_pandas()
    assert less.beam.max() > 100 and less.found_pairs.sum() == less.true_pairs.sum()
    assert less.n.sum() == whole.n.sum()


def test_links_are_both_ways_and_bounded():
    rng = np.random.default_rng(4)
    g, _ = hnsw.Graph.built(np.arange(1500), rng.normal(size=(1500, 8)).astype(np.float32))
    low = g.layers[-1]
    assert low.shape[1] >= 2 * hnsw.LINKS and len(low) == 1500 and low.max() < 1500 and (low != np.arange(1500)[:, None]).all()
    for row in low[:200]:
        own = row[row >= 0]
        assert len(set(own.tolist())) == len(own)



def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = queries()["op7_near_vectors"](spark, small).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
