import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tiltyard.llm import base


@pytest.mark.parametrize("kind", ["path", "star", "to_the_greatest", "random", "cycle", "empty", "loops"])
def test_components(spark, kind):
    rnd, n = random.Random(3), 300
    edges = {
        "path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "to_the_greatest": [(n, i) for i in range(n)],
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)], "cycle": [(i, (i + 7) % n) for i in range(n)], "empty": [], "loops": [(1, 1), (2, 2)],
    }[kind]
    name = list(range(n + 1))
    rnd.shuffle(name)
    edges = [(name[a], name[b]) for a, b in edges] * 2
    forest = base.Forest(n + 1)
    for a, b in edges:
        forest.join(a, b)
    got = base.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.id for r in got}) == len(got)
    assert {r.id: r.root for r in got} == {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é\n\t\x0b", max_size=20)), max_size=8), st.integers(1, 30))
def test_words(texts, limit):
    import re

    seen = []
    for part in base.chunks(pa.array(texts, pa.string()), lower=True, limit=limit):
        words = [bytes(part.data[s:e]).decode() for s, e in zip(part.start, part.end)]
        seen += [words[a:b] for a, b in zip(part.bounds, part.bounds[1:])]
        assert len(set(zip(words, part.hashes().tolist()))) == len(set(words)) == len(set(part.hashes().tolist()))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]


def test_sliced_and_chunked_columns():
    column = pa.chunked_array([pa.array(["a b", None]), pa.array(["c"])])
    assert [p.n_words.tolist() for p in base.chunks(column.slice(1))] == [[0, 1]]


def test_grouped_across_batches():
    rows = pa.table({"k": [1, 1, 1, 2, 3, 3], "j": [0, 0, 1, 1, 1, 1], "v": [1, 2, 3, 4, 5, 6]})
    for size in (1, 2, 4, 6):
        got = [t["v"].to_pylist() for t in base.Grouped(rows.to_batches(max_chunksize=size), ["k", "j"])]
        assert got == [[1, 2], [3], [4], [5, 6]]


def test_long_words_hash_apart():
    data = np.frombuffer(b"x" * 9000 + b"y" + b"x" * 9000, np.uint8)
    h = base.span_hashes(data, np.array([0, 9001, 0]), np.array([9000, 18001, 9001]))
    assert h[0] == h[1] != h[2]


def test_shared_dir_is_the_sessions(spark):
    assert base.shared_dir(spark) == base.shared_dir(spark)
    got, seen = base.materialize(spark.range(5), base.F.count("id").alias("n"))
    assert seen == {"n": 5} and got.count() == 5
    base.clear_written(spark)
