import random

import numpy as np
import pyarrow as pa
import pytest

from tiltyard.llm import base, neardup
from tiltyard.llm.queries import queries


def sets_of(texts):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts):
    sets = sets_of(texts)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(ids[a]), find(ids[b])
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def edited(text, rnd, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def same_as_brute(df, ids, texts):
    want = brute(ids, texts)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(ids)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_planted_copies(docs, prose):
    rnd = random.Random(6)
    texts = []
    for k in range(12):
        start = prose(k, 60 + 40 * k)
        texts += [start, start.upper(), start + " tail"] + [edited(start, rnd, 1 + j) for j in range(6)]
    passage = prose(99, 150)  # many documents share it and are no copies
    texts += [f"{prose(200 + k, 60)} {passage}" for k in range(30)] + [prose(300 + k, 100) for k in range(40)]
    ids = random.Random(1).sample(range(1000), len(texts))
    same_as_brute(docs(texts, ids, extra=True), ids, texts)


def test_chains_and_many_blocks(docs, prose, monkeypatch):
    """Blocks of a few rows, so that large groups and buckets take the ways of many blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SKETCHES", 8)
    rnd = random.Random(8)
    start, texts = prose(5, 120), []
    at = start
    for _ in range(60):  # each a little further from the first
        at = edited(at, rnd, 1)
        texts.append(at)
    texts += [edited(start, rnd, 3) for _ in range(60)]
    ids = rnd.sample(range(500), len(texts))
    same_as_brute(docs(texts, ids), ids, texts)


def test_odd_rows(docs, odd_texts):
    ids = list(range(len(odd_texts)))
    same_as_brute(docs(odd_texts, ids, extra=True), ids, odd_texts)
    with_null = docs([*odd_texts, "no id at all here now", "no id at all here now"], [*ids, None, None])
    got = neardup.near_duplicates(with_null).where("doc_id is null").collect()
    assert len(got) == 2 and all(r.kept and r.component_id is None for r in got)
    twice = neardup.near_duplicates(docs(["a b c d e f"] * 3, [7, 7, 8])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in twice) == [(7, 7, True), (7, 7, True), (8, 7, False)]
    assert neardup.near_duplicates(with_null.where("false")).count() == 0


def test_blocks_by_size(docs, prose, monkeypatch):
    """Long texts fill a block with few of them."""
    monkeypatch.setattr(neardup, "ELEMENTS", 20_000)
    rnd = random.Random(4)
    start = prose(11, 3000)
    texts = [edited(start, rnd, rnd.choice([30, 120, 160])) for _ in range(60)] + [prose(50 + k, 400) for k in range(10)]
    ids = rnd.sample(range(500), len(texts))
    same_as_brute(docs(texts, ids), ids, texts)


def test_one_row_of_each_group(docs, prose):
    """Null ids, ids of two texts and repeated rows: one row of each group stays, whatever its id."""
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(None, a), (None, a + " x"), (None, b), (7, b), (7, b), (7, c), (3, c + " y"), (7, c), (9, None), (9, None), (9, "")]
    df = docs([t for _, t in rows], [i for i, _ in rows], extra=True).selectExpr("*", "1 as of_t1", "2 as t1", "3 as first")
    out = neardup.keep_first(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((x for x in got if x[0] is not None), key=repr) == sorted([(7, b), (3, c + " y"), (9, None), (9, None), (9, "")], key=repr)
    assert [t in (a, a + " x") for i, t in got if i is None] == [True]


def test_keep_first(docs, prose):
    a, b = prose(1, 50), prose(2, 50)
    df = docs([a, b, a, a + " x", None], [4, 3, 2, 9, 1], extra=True)
    out = neardup.keep_first(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3]


@pytest.mark.parametrize("similarity", [0.6, 0.75, 0.9])
def test_sketches_estimate(similarity):
    rng = np.random.default_rng(2)
    off = []
    for _ in range(30):
        n = 400
        common = int(2 * n * similarity / (1 + similarity))
        all_ = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        low = np.stack([neardup.minima(all_[:n]), neardup.minima(all_[n - common : 2 * n - common])]).astype(np.uint64)
        place = (base.mix(low * np.uint64(0x9E3779B97F4A7C15) + neardup._FOLD) % np.uint64(neardup.SKETCH_BITS)).astype(int)
        bits = np.stack([np.bincount(p, minlength=neardup.SKETCH_BITS) & 1 for p in place]).astype(np.uint8)
        s = np.packbits(bits, axis=1).view(np.uint64)
        off.append(neardup.estimates(s[:1], s[1:])[0] - common / (2 * n - common))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_exact_links_are_exact():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**62, 60)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(40)]
    table = pa.table({"id": np.arange(40), "root": np.arange(40), "hashes": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    forest = base.Forest(40)
    for a in range(40):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                forest.join(a, b)
    got = base.Forest(40)
    out = neardup.exact_links(table)
    for a, b in zip(out["a"], out["b"]):
        got.join(a, b)
    assert [got.find(i) for i in range(40)] == [forest.find(i) for i in range(40)]


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = brute([r.doc_id for r in rows], [r.text for r in rows])
    got = queries()["op2_near_duplicates"](spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
