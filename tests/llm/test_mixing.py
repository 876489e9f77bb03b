from collections import Counter

import numpy as np
import pytest

from tiltyard.llm import mixing
from tiltyard.llm.queries import oracle_sql, queries


def test_same_as_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    sql = con.sql(oracle_sql()["op5_mix"])
    got = queries()["op5_mix"](spark, small)
    assert got.columns == sql.columns
    key = lambda r: (r[0], r[-1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(sql.fetchall(), key=key)


def test_broadcast_or_dealt(docs, prose, monkeypatch):
    """Many sources' rates are joined instead of broadcast, with the same rows."""
    df = docs([prose(k, 5) for k in range(300)], sources=[None if k % 3 == 0 else f"s{k % 40}" for k in range(300)])
    small = mixing.mix(df)
    monkeypatch.setattr(mixing, "NUMBERS", 10)
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, small.collect()))


def test_shares_come_near_weights(docs):
    texts = ["x" * 99] * 6000
    sources = ["big"] * 5000 + ["mid"] * 900 + ["small"] * 100
    out = mixing.mix(docs(texts, sources=sources), {"big": 1, "mid": 1, "small": 2}, epochs=2.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert sum(n.values()) == pytest.approx(12_000, rel=0.05)
    assert n["small"] / sum(n.values()) == pytest.approx(0.5, abs=0.03) and n["big"] == pytest.approx(n["mid"], rel=0.1)


def test_draws_are_poisson(docs):
    from math import exp, factorial

    out = mixing.mix(docs(["x"] * 4000), {"s": 1}, epochs=1.5)
    per = Counter(r.doc_id for r in out.select("doc_id").collect())
    counts = Counter(per.get(i, 0) for i in range(4000))
    for k in range(5):
        assert counts[k] / 4000 == pytest.approx(exp(-1.5) * 1.5**k / factorial(k), abs=0.03)


def test_large_means_are_sums_of_parts(docs):
    n = mixing.mix(docs(["x", "y"]), {"s": 1}, epochs=1200.0).groupBy("doc_id").count().collect()
    assert all(r["count"] == pytest.approx(1200, rel=0.15) for r in n)


def test_columns_order_and_odd_rows(docs, odd_texts):
    df = docs(odd_texts, [None, *range(1, len(odd_texts))], sources=[None, "a", "b", "a", "a", "b", "a", "a", "b", None], extra=True)
    out = mixing.mix(df, temperature=1.0, epochs=20.0)
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    rows = out.select("doc_id", "source", "copy", "shuffle_key").collect()
    again = mixing.mix(df, temperature=1.0, epochs=20.0).select("doc_id", "source", "copy", "shuffle_key").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and {r.source for r in rows} == {None, "a", "b"}
    for i, c in Counter(r.doc_id for r in rows).items():
        assert sorted(r.copy for r in rows if r.doc_id == i) == list(range(1, c + 1))
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df, {"nowhere": 1}).count() == 0


def test_order_is_shuffled(docs):
    ids = [r.doc_id for r in mixing.mix(docs(["x"] * 2000), {"s": 1}).select("doc_id").collect()]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
