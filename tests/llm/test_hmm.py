import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tiltyard.llm import hmm
from tiltyard.llm.queries import queries


def model(rng, states, symbols):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.uniform(0.1, 1, states), 0), norm(rng.uniform(0.1, 1, (states, states)), 1), norm(rng.uniform(0.1, 1, (symbols, states)), 0))


def paths(seq, m):
    """The probability of a sequence as a sum over all paths of states."""
    a = m.start * m.emit[seq[0]]
    for x in seq[1:]:
        a = (a @ m.move) * m.emit[x]
    return a.sum()


def flat(seqs):
    return np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])


@pytest.mark.parametrize("size", [1, 3, 512])
def test_forward_is_exact(size):
    rng = np.random.default_rng(1)
    m = model(rng, 3, 7)
    seqs = [rng.integers(0, 7, n) for n in (1, 2, 9, 40, 5, 1, 33)]
    got = hmm.log_likelihoods(*flat(seqs), m, size)
    assert got == pytest.approx([math.log10(paths(s, m)) for s in seqs], rel=1e-9)


def test_all_sequences_sum_to_one():
    from itertools import product

    m = model(np.random.default_rng(2), 2, 3)
    seqs = [np.array(s) for s in product(range(3), repeat=4)]
    assert (10 ** hmm.log_likelihoods(*flat(seqs), m)).sum() == pytest.approx(1)


def test_expected_counts_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    m = model(rng, 2, 4)
    seqs = [rng.integers(0, 4, n) for n in (1, 4, 6)]
    got = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((4, 2))}
    ids, off = flat(seqs)
    hmm.expected(ids, off[:-1], np.diff(off), m, got)
    got["move"] *= m.move
    want = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((4, 2))}
    for s in seqs:
        weights = {}
        for z in product(range(2), repeat=len(s)):
            p = m.start[z[0]] * m.emit[s[0], z[0]]
            for t in range(1, len(s)):
                p *= m.move[z[t - 1], z[t]] * m.emit[s[t], z[t]]
            weights[z] = p
        total = sum(weights.values())
        for z, p in weights.items():
            want["start"][z[0]] += p / total
            for t in range(len(s)):
                want["emit"][s[t], z[t]] += p / total
                if t:
                    want["move"][z[t - 1], z[t]] += p / total
    for k in want:
        assert got[k] == pytest.approx(want[k])


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for x, h in zip(tokens, held)]


def same_base(got, rows):
    want = sorted(((-1 if i is None else i), *b) for (i, _), b in zip(rows, brute(rows)))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert [h[5] for h in have] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)


def test_query_and_gain(spark, small):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries()["op8_hmm_score"](spark, small).collect()
    same_base(got, table)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # closer than words by themselves


def test_model_scores_sum_to_one(docs, spark):
    """Over one-word texts: all known words, one that training never saw, and the empty text's complement."""
    rows = [(i, t) for i, t in enumerate(["a a b", "a c", "b b", "c a b", "", "a", "b", "c", "zz"] * 4)]
    got = {}
    for r in hmm.score(docs([t for _, t in rows], [i for i, _ in rows]), states=2, near=2, lead=1).collect():
        got.setdefault(rows[r.doc_id][1], set()).add(round(r.score, 9))
    assert all(len(v) == 1 for v in got.values())
    one = {t: 10 ** next(iter(v)) for t, v in got.items()}
    assert one["zz"] < one["a"] and sum(one[t] for t in ("", "a", "b", "c", "zz")) < 1


def test_vocabulary_limits_change_no_counts(docs, prose):
    rows = [(i, prose(i % 5, 30 + i)) for i in range(40)]
    df = docs([t for _, t in rows], [i for i, _ in rows])
    for near, lead in ((1 << 18, 1 << 15), (50, 10), (3, 3), (0, 0)):
        same_base(hmm.score(df, states=3, rounds=1, near=near, lead=lead).collect(), rows)


def test_every_word_has_its_own_emissions(docs, prose, monkeypatch):
    """Few words are near and fewer lead: the counts of all are still those of the recursion over whole texts, and
    each state's shares sum to one."""
    monkeypatch.setattr(hmm, "FAR_HELD", 40)
    texts = [prose(k % 6, 60) for k in range(40)]
    rows = docs(texts, [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2][:40])
    counts = hmm.word_counts(rows).cache()
    v = hmm.vocabulary(counts, 40 * 60, counts.count(), 40, near=20, lead=5)
    assert 0 < v.near <= 20 and v.lead <= 5
    coded = hmm.encoded(rows, rows.sparkSession.sparkContext.broadcast(v)).cache()
    m = hmm.first_model(np.zeros((0, 0)), v.plain(), 3)
    found = hmm.gathered(coded, m, v).cache()
    number: dict = {}
    seqs = [np.array([number.setdefault(w, len(number)) for w in [*t.split(), None]]) for t in texts]
    own = {r["hash"]: r["n"] for r in counts.collect()}
    from tiltyard.llm.base import Chunk

    def hashed(w):
        raw = np.frombuffer(w.lower().encode(), np.uint8)
        return int(Chunk(0, raw, np.array([0, len(raw)]), True).hashes().view(np.int64)[0])

    lead = {h: i for i, h in enumerate(sorted(own, key=lambda h: (-own[h], h))[: v.lead])}
    emit = {w: v.lead + 1 if w is None else lead.get(hashed(w), v.lead) for w in number}
    wide = hmm.Model(m.start, m.move, np.array([m.emit[emit[w]] for w in number]))
    want = whole_counts(seqs, wide)
    got = {r["hash"]: r for r in found.where("hash is not null").groupBy("hash").sum("c0", "c1", "c2").collect()}
    for w, i in number.items():
        if w is not None:
            assert [got[hashed(w)][f"sum(c{k})"] for k in range(3)] == pytest.approx(list(want["emit"][i]), rel=1e-4)
    _, emissions, table = hmm.all_words(counts, found, v, 3)
    t = table.toPandas()
    shares = emissions.of(t["n"].to_numpy(), t["code"].to_numpy())
    rest = v.total - (t["n"][t["n"] >= 2] + 1).sum() - v.end_weight - (t["n"][t["n"] < 2] + 1).sum()
    assert shares.sum(axis=0) + emissions.end + emissions.rest * rest == pytest.approx(np.ones(3))
    assert len({tuple(x) for x in t["code"][t["n"] >= 2].to_numpy().reshape(-1, 1)}) > v.near


def test_odd_rows(docs, odd_texts):
    rows = list(zip([None, *range(1, len(odd_texts))], odd_texts))
    df = docs(odd_texts, [i for i, _ in rows], extra=True)
    got = hmm.score(df).collect()
    same_base(got, rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert hmm.score(df.where("false")).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    alone = hmm.score(docs(["a b", "", None], only_held)).collect()
    assert [(r.train_tokens, r.base_score, round(r.score, 12)) for r in alone] == [(0, 0.0, 0.0)] * 3


def whole_counts(seqs, m):
    want = {"start": np.zeros(len(m.start)), "move": np.zeros(m.move.shape), "emit": np.zeros(m.emit.shape)}
    ids, off = flat(seqs)
    hmm.expected(ids, off[:-1], np.diff(off), m, want)
    return want


@pytest.mark.parametrize("size", [1, 3, 7])
def test_runs_give_the_counts_of_whole_texts(size):
    rng = np.random.default_rng(4)
    m = model(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 20, 3, 7, 6, 41, 2)] + [rng.integers(0, 5, 5000)]
    got = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((5, 3))}
    hmm.expected_texts(*flat(seqs), m, got, size)
    want = whole_counts(seqs, m)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-8)


def test_a_round_learns_across_runs(spark):
    rng = np.random.default_rng(5)
    m = model(rng, 2, 4)
    seqs = [rng.integers(0, 4, n) for n in (3 * hmm.SEGMENT + 5, 9)]
    plain = np.full(4, 0.25)
    rows = spark.createDataFrame([([int(x) for x in s],) for s in seqs], "ids array<int>")
    got, want = hmm.baum_welch(rows, m, plain), whole_counts(seqs, m)
    start, move = want["start"] + 0.1, want["move"] * m.move + 0.1
    assert got.start == pytest.approx(start / start.sum()) and got.move == pytest.approx(move / move.sum(axis=1, keepdims=True))
