import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tiltyard.llm import packing, tokens
from tiltyard.llm.queries import tokenizer_path

PATH = tokenizer_path()
SLOW = Tokenizer.from_file(PATH)


def encoder_of(content):
    return tokens.Encoder(tokens.planned(content), lambda: content)


ENCODER = encoder_of(open(PATH).read())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([" ", "\n", "it's", "'ll", "é", "漢字", "😀", "٣", "<|endoftext|>", "\x00", "\x85", "  "]), max_size=20).map("".join)))
def test_ids_are_the_tokenizers(text):
    assert ENCODER.fast is not None
    assert ENCODER.ids(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_other_files_go_the_slow_way():
    other = encoder_of(open(public_tokenizers.path("word_bpe_49k.json")).read())
    assert other.fast is None and len(other.ids("Hello there")) == 2
    told = json.loads(open(PATH).read())
    told["model"]["merges"] = told["model"]["merges"][::-1]
    assert encoder_of(json.dumps(told)).fast is None


def lengths(texts):
    return [len(SLOW.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


def test_histogram(docs, odd_texts, prose):
    texts = odd_texts + [prose(i, 5 + i % 4) for i in range(40)]
    n = lengths(texts)
    df = docs(texts, extra=True)
    hist = tokens.length_histogram(df, PATH, block=7).cache()
    got = {r.n_tokens: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert r.docs_above == sum(x > k for x in n) and r.docs_below == sum(x < k for x in n)
        assert r.tokens_above == sum(x for x in n if x > k) and r.truncated_tokens == sum(min(x, k) for x in n)
        assert r.quantile == pytest.approx(sum(x <= k for x in n) / len(n))
    for limit in (0, 3, 50, 10**6):
        t = tokens.totals_at(hist, limit).first()
        assert (t.docs, t.docs_over, t.tokens, t.tokens_left) == (len(n), sum(x > limit for x in n), sum(n), sum(min(x, limit) for x in n))
    assert tokens.quantile(hist, 0.5).first().n_tokens == sorted(n)[(len(n) - 1) // 2]
    none = tokens.length_histogram(df.where("false"), PATH)
    assert none.count() == 0 and tokens.totals_at(none, 5).first().docs == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_is_a_partition(sizes, windows):
    at = packing.differencing(np.array(sizes), windows)
    assert len(at) == len(sizes) and at.min() >= 0 and at.max() < windows


def test_differencing_balances():
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 300, 2000)
    w = np.bincount(packing.differencing(sizes, 64), weights=sizes)
    assert w.max() - w.min() < 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=50))
def test_fit_never_exceeds(sizes):
    sizes = np.array(sizes)
    assert np.bincount(packing.fit(sizes, 64), weights=sizes).max() <= 64


@given(st.integers(1, 10_000))
def test_pieces_cover(n):
    at = 0
    for start, size in packing.pieces(n, 2048):
        assert start == at and 0 < size <= 2048
        at += size
    assert at == n


def check_packing(rows, texts, ids, capacity=2048):
    own = {i: np.array((SLOW.encode(t, add_special_tokens=False).ids if t else []) + [1], "<u4") for i, t in zip(ids, texts)}
    sequences, seen = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            assert r.doc_tokens == len(own[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes())
            seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for pieces in seen.values():
        at = 0
        for start, size in sorted(pieces):
            assert start == at
            at += size
    assert {i: sum(n for _, n in p) for i, p in seen.items()} == {i: len(x) for i, x in own.items() if i is not None}
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_round_trip(docs, odd_texts, prose):
    texts = odd_texts + [prose(i, 50 + 37 * (i % 40)) for i in range(200)]
    ids = [None, *range(1, len(texts))]
    df = docs(texts, ids, extra=True)
    rows = packing.pack(df, PATH, block=8, ids=True).collect()
    padding = check_packing(rows, texts, ids)
    assert padding < 0.05 * sum(r.length for r in rows)
    for r in rows[:50]:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_repeated_rows_are_packed_each_time(docs):
    rows = packing.pack(docs(["one two"] * 3, [5, 5, 5]), PATH).collect()
    assert sorted((r.doc_id, r.start) for r in rows) == [(5, 0)] * 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_query(spark, small):
    from tiltyard.llm.queries import queries

    table = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = queries()["op1_pack"](spark, small).collect()
    assert check_packing(rows, [r.text for r in table], [r.doc_id for r in table]) < 0.05 * sum(r.length for r in rows)
    n = Counter(lengths([r.text for r in table]))
    assert {r.n_tokens: r.n_docs for r in queries()["op6_token_counts"](spark, small).collect()} == n
