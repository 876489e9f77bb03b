import zlib

import numpy as np

from tiltyard.llm import classifier


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(y, s):
    pos, neg = s[y], s[~y]
    return ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()


def test_held_out_accuracy(spark, docs, prose):
    texts = [prose(i, 60) for i in range(300)] + [" ".join(w + "&&&" for w in prose(i, 60).split()) for i in range(300, 400)] + [f"{prose(i, 6)}\n" * 12 for i in range(400, 500)]
    labels = [(i, int(i < 300)) for i in range(500)]
    flipped = [(i, 1 - q if held(i) else q) for i, q in labels]  # what is held out must teach nothing
    df = docs(texts, extra=True)
    got = {r.doc_id: r for r in classifier.classify(df, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()}
    assert len(got) == 500 and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    out = [i for i in got if held(i)]
    y = np.array([i < 300 for i in out])
    assert auc(y, np.array([got[i].score for i in out])) > 0.97
    again = classifier.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in got.items()}


def test_only_texts_matter(spark, docs, prose):
    texts = [prose(i, 40) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)], "doc_id long, quality int")
    # All of a run's texts shape its word vectors, so equal texts of one run are held against each other.
    df = docs(texts + texts, [*range(60), *range(1000, 1060)], sources=[*["s"] * 60, *["other"] * 60])
    got = {r.doc_id: r.score for r in classifier.classify(df, labels).collect()}
    assert all(abs(got[i] - got[i + 1000]) < 1e-6 for i in range(60))


def test_odd_rows(spark, docs, odd_texts):
    df = docs(odd_texts, [None, *range(1, len(odd_texts))], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = classifier.classify(df, none).collect()
    assert len(rows) == len(odd_texts) and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert all(r.score > 0.7 for r in classifier.classify(df, one).collect())
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    assert all(np.isfinite(r.score) for r in classifier.classify(df, both).collect())
    assert classifier.classify(df.where("false"), both).count() == 0


def brute_context(texts):
    """Context vectors by definition, word by word."""
    from tiltyard.llm.base import Chunk

    def bucket(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(Chunk(0, raw, np.array([0, len(raw)]), False).hashes()[0] % np.uint64(classifier.BUCKETS))

    total, n = np.zeros((classifier.BUCKETS, classifier.SIZE)), np.zeros(classifier.BUCKETS)
    index, of_byte = classifier.index_vectors(classifier.BUCKETS, 21), classifier.index_vectors(256, 22)
    for t in texts:
        b = [bucket(w) for w in t.split()]
        own = [index[x] + of_byte[list(w.encode())].mean(axis=0) for x, w in zip(b, t.split())]
        for i, x in enumerate(b):
            n[x] += 1
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if j != i:
                    total[x] += own[j]
    total -= n[:, None] * total.sum(axis=0) / n.sum()
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), bucket


def test_context_vectors_and_pooling(docs, prose):
    import pyarrow as pa

    texts = [prose(k, 25) for k in range(30)]
    want, bucket = brute_context(texts)
    got = classifier.context_vectors(docs([*texts, None, ""]))
    assert np.abs(got - want).max() < 1e-4
    x = classifier.pooled(pa.array([texts[3], None, "one"]), got)
    v = want[[bucket(w) for w in texts[3].split()]]
    assert np.abs(x[0, :64] - v.mean(axis=0)).max() < 1e-4 and np.abs(x[0, 64:128] - v.std(axis=0)).max() < 1e-3
    assert abs(x[0, 128] - (v[1:] * v[:-1]).sum() / len(v)) < 1e-4 and abs(x[0, 129] - np.linalg.norm(v.mean(axis=0))) < 1e-4
    assert (x[1] == 0).all() and x[2, -2] > 0


def test_query(spark, small):
    """The registered query: the split, the law of ``predicted``, and scores of the network over brute features."""
    import pyarrow as pa

    from tiltyard.llm.queries import queries

    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None}
    got = {r.doc_id: r for r in queries()["op3_quality_score"](spark, small).collect()}
    assert set(got) == {r.doc_id for r in rows}
    assert all(r.held_out == held(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    vectors = brute_context([r.text for r in rows if r.text and not held(r.doc_id)])[0].astype(np.float32)
    taught = [r for r in rows if r.doc_id in labels and not held(r.doc_id)]
    taught.sort(key=lambda r: int(classifier.mix(np.array([r.doc_id], np.uint64))[0]))
    net = classifier.train(classifier.pooled(pa.array([r.text for r in taught]), vectors).astype(float), np.array([labels[r.doc_id] == 1 for r in taught]))
    want = net.probability(classifier.pooled(pa.array([r.text for r in rows]), vectors))
    assert np.abs(want - [got[r.doc_id].score for r in rows]).max() < 0.05


def test_repeated_ids_bound_what_teaches(spark, docs, prose):
    """Labels that meet many documents each teach no more of them than the bound."""
    df = docs([prose(k, 20) + " &&&" * (k % 2) for k in range(400)], [k % 20 for k in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    real, classifier.train = classifier.train, lambda x, y: seen.append(len(y)) or real(x, y)
    try:
        rows = classifier.classify(df, labels, rows=90).collect()
    finally:
        classifier.train = real
    assert len(rows) == 400 and seen == [90]


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = rng.uniform(size=3000) < 1 / (1 + np.exp(-2 * x[:, 0]))
    net = classifier.train(x, y)
    p = net.probability(x)
    assert 0.25 <= net.temperature <= 8 and abs(p.mean() - y.mean()) < 0.05
    for lo in (0, 0.25, 0.5, 0.75):
        part = (p >= lo) & (p < lo + 0.25)
        assert abs(p[part].mean() - y[part].mean()) < 0.08


def test_index_vectors_are_sparse():
    v = classifier.index_vectors(500, 3)
    assert (np.abs(v).sum(axis=1) <= 6).all() and abs((v @ v.T)[~np.eye(500, dtype=bool)].mean()) < 0.1
