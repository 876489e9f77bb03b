import zlib
from collections import Counter, defaultdict

import pytest

from tiltyard.llm import sharding
from tiltyard.llm.queries import queries


def size(t):
    return len((t or "").encode()) + 1


def check(rows, table, shards, slack):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in table)
    text = dict(table)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == size(text[r.doc_id]) and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(load.values()) / shards
    assert max(load.values()) - target <= slack and target - min(load.get(s, 0) for s in range(shards)) <= slack
    return load


def test_query_is_nearly_even(spark, small):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    total = sum(size(t) for _, t in table)
    check(queries()["op4_shard"](spark, small).collect(), table, 8, 0.04 * total / 8 + 200)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_and_buckets(docs, prose, shards):
    texts = [prose(i, 20 + i % 60) for i in range(600)]
    table = list(enumerate(texts))
    check(sharding.shard(docs(texts, extra=True), shards, rows_a_bucket=17).collect(), table, shards, 0.01 * sum(map(size, texts)) / shards)


def test_a_group_of_a_third_is_split_and_small_groups_are_not(docs, prose):
    texts = [prose(1, 60)] * 300 + [prose(i // 3, 55) for i in range(100, 700)]
    table = list(enumerate(texts))
    rows = sharding.shard(docs(texts)).collect()
    check(rows, table, 8, 0.03 * sum(map(size, texts)) / 8)
    where = defaultdict(set)
    for r in rows:
        if r.doc_id >= 300:
            where[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 7  # one a cut at most


def test_odd_rows(spark, docs, odd_texts):
    df = docs(odd_texts, [None, *range(1, len(odd_texts))], extra=True)
    rows = sharding.shard(df).collect()
    assert len(rows) == len(odd_texts)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(df).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.shard(df.where("false")).count() == 0
    bare = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    assert sharding.shard(bare, 4).count() == 50
    ties = docs(["same"] * 100, [3] * 100)
    got = sharding.shard(ties).collect()
    assert len(got) == 100 and {(r.size, r.text_crc32) for r in got} == {(5, zlib.crc32(b"same"))}


def test_fill_takes_whole_units_first():
    rows = [(1, 10, 5), (1, 11, 5), (2, 12, 7), (3, 13, 3)]
    assert sorted(sharding.fill(rows, 10, 100)) == [10, 11]
    assert sorted(sharding.fill(rows, 8, 0.0)) == [12]
    assert sharding.fill(rows, 0, 0.0) == ()


def loads(rows, shards):
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    return [load[i] for i in range(shards)]


def test_many_equal_rows_all_stay_and_are_split(docs):
    rows = sharding.shard(docs(["same"] * 1000, [3] * 1000)).collect()
    assert len(rows) == 1000 and max(loads(rows, 8)) - min(loads(rows, 8)) <= 5
    rows = sharding.shard(docs(["same"] * 5000, [None] * 5000)).collect()  # more than a run of copies
    assert len(rows) == 5000 and max(loads(rows, 8)) - min(loads(rows, 8)) <= 5


def test_a_third_of_null_ids(docs, prose):
    texts = [prose(i, 20 + i % 60) if i % 3 else prose(i % 9, 50) for i in range(1800)]
    rows = sharding.shard(docs(texts, [i if i % 3 else None for i in range(1800)])).collect()
    assert Counter(r.text_crc32 for r in rows) == Counter(zlib.crc32(t.encode()) for t in texts)
    assert sum(r.doc_id is None for r in rows) == 600
    target = sum(map(size, texts)) / 8
    assert max(abs(x - target) for x in loads(rows, 8)) <= 0.03 * target


def test_null_ids_of_different_texts(docs, prose):
    texts = [prose(i, 20 + i % 60) for i in range(900)]
    rows = sharding.shard(docs(texts, [i if i % 3 else None for i in range(900)])).collect()
    target = sum(map(size, texts)) / 8
    assert len(rows) == 900 and max(abs(x - target) for x in loads(rows, 8)) <= 0.03 * target
