import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tiltyard.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


PARTS = ["a", "b", "\n", " ", "\t", "é", "#", "a b c d e f g h", "\r", "\x0b", "x\ny\nx", "漢字 ", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)), max_size=5))
def test_counts(texts):
    got = quality.counts_of(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*[got[n].tolist() for n in names])) == [brute(t) for t in texts]


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, len(quality.RATES)))
    bad = ((x[:, 2] > 0.9) | ((x[:, 4] > 0.8) & (x[:, 5] < 0.2))) & (rng.uniform(size=3000) > 0.01)
    rules = quality.covering(x, bad)
    hit = np.zeros(3000, bool)
    names = list(quality.RATES)
    for rule in rules:
        hit |= np.logical_and.reduce([(x[:, names.index(n)] > t) if above else (x[:, names.index(n)] <= t) for n, above, t in rule])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.05 * hit.sum()
    assert quality.covering(x, np.zeros(3000, bool)) == []


def test_rules_and_odd_rows(spark, docs, odd_texts, prose):
    good = [prose(i, 80) for i in range(100, 160)]
    junk = [" ".join(f"{w}###" for w in prose(i, 60).split()) for i in range(200, 260)]
    texts = [*odd_texts, *good, *junk]
    ids = [None, *range(1, len(texts))]
    df = docs(texts, ids, extra=True)
    n = len(odd_texts)
    labels = spark.createDataFrame([(i, int(i < n + 60)) for i in range(n, len(texts), 2)] + [(None, 1), (5, None), (10**9, 0)], "doc_id long, quality int")
    got = quality.quality_rules(df, labels).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].kept for i in range(n, n + 60)) and not any(by[i].kept for i in range(n + 60, len(texts)))
    for i in ids[1:n]:
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words) == brute(texts[i])
        assert by[i].base_failed == (by[i].n_words < 20 or 100 * by[i].n_repeat_words > 30 * by[i].n_words)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where(f"doc_id >= {n}").count() == 60
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(df, empty).where("rule > 0").count() == 0
    assert quality.quality_rules(df.where("false"), labels).count() == 0


def test_list_is_a_spark_condition(spark, docs, prose):
    plan = quality.quality_rules(docs([prose(1, 30)]), None, [[("symbol_rate", True, 0.1), ("n_words", False, 50.0)], [("mark_rate", True, 0.2)]])
    said = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in said


def test_registered_query(spark, small):
    """Base counts and base_failed by definition; kept by the learned list, read as plain conditions."""
    from tiltyard.llm.queries import queries

    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rules = quality.learn_rules(docs, labels)
    assert rules
    got = queries()["op9_quality_rules"](spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        counts = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        value = {k: r[a] / (max(1, r[b]) if b else 1) for k, (a, b) in quality.RATES.items()}
        first = next((i for i, rule in enumerate(rules, 1) if all((value[n] > t) if above else (value[n] <= t) for n, above, t in rule)), 0)
        assert r.rule == first and r.kept == (not r.base_failed and first == 0)


def test_repeated_ids_bound_what_teaches(spark, docs, prose, monkeypatch):
    """Labels that meet many documents each bring no more of them to the driver than the bound."""
    seen = []
    monkeypatch.setattr(quality, "covering", lambda x, bad, precision: seen.append(len(bad)) or [])
    df = docs([prose(k, 20) for k in range(400)], [k % 20 for k in range(400)])
    quality.learn_rules(df, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"), rows=90)
    assert seen == [90]
