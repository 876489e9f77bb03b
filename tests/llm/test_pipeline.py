import os
import re
import shutil
import subprocess
import sys

import corpus_pipeline
from tests.llm.test_neardup import brute as groups
from tests.llm.test_secrets import brute as secrets_in
from tiltyard.llm import quality

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
        rows = docs.collect()
        if name == "quality_rules":
            counts = quality.quality_rules(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
            assert {r.doc_id for r in rows} == {r.doc_id for r in counts.collect() if r.kept}
            good = [i for i, q in labels.items() if q == 1 and len(before[i].text.split()) >= 20]
            assert sum(i in {r.doc_id for r in rows} for i in good) >= 0.98 * len(good)
        if name == "near_dedup":
            kept = list(before)
            want = groups(kept, [before[i].text for i in kept])
            assert {r.doc_id for r in rows} == {i for i in kept if want[i][1] == i}
        if name == "secret_scan":
            assert {r.doc_id for r in rows} == set(before)
            for r in rows:
                assert not secrets_in(r.text) and r.n_chars == len(r.text)
                if not secrets_in(before[r.doc_id].text) and "[secret]" not in r.text:
                    assert r.text == before[r.doc_id].text
        if name == "mix_sources":
            assert {r.doc_id for r in rows} <= set(before) and all(r.text == before[r.doc_id].text for r in rows)
        if name == "pack":
            assert sum(r.length for r in rows if r.start == 0) > 0 and max(r.offset + r.length for r in rows) <= 2048
        before = {r.doc_id: r for r in rows} if name != "pack" else before


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None
    starts = [r for r in rows if r.start == 0]
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in starts) and all(len(r.ids) == r.length for r in rows)


def test_stages_take_odd_rows(spark, small, docs, odd_texts, prose):
    """Nulls, empty and long texts, repeats, no rows, and columns with the operators' own names, through every stage."""
    texts = [*odd_texts, prose(5, 80), prose(5, 80), "password = hunter2hunter2 " + prose(6, 80)]
    df = docs([*texts, prose(7, 60)], [*range(len(texts)), None], [None, "a", "b"] * 4 + ["a", "b"], extra=True).selectExpr("*", "5 as copy", "'k' as shuffle_key", "6 as n_words", "7 as start", "8 as t1", "9 as length")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.where("false"), small)
        out = stage(spark, df, small)
        rows = out.collect()
        assert none.count() == 0 and none.columns == out.columns
        if name != "pack":
            assert out.columns == df.columns
            assert all((r.copy, r.shuffle_key, r.n_words, r.start, r.t1, r.length, r.kept) == (5, "k", 6, 7, 8, 9, 1) for r in rows)
        got = sorted((r.doc_id for r in rows), key=repr)
        if name == "quality_rules":
            assert {i for i in got if i is not None} <= {i for i, t in enumerate(texts) if t and len(t.split()) >= 20} and None in got
        if name == "near_dedup":
            want = groups(list(range(len(texts))), texts)
            assert got == sorted([*(i for i in range(len(texts)) if want[i][1] == i), None], key=repr)
        if name == "secret_scan":
            assert len(rows) == df.count() and not any("hunter2" in (r.text or "") for r in rows) and sum(r.text is None for r in rows) == 1
        if name == "mix_sources":
            assert all(r.text in [*texts, prose(7, 60)] for r in rows)
        if name == "pack":
            assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows) and {r.doc_id for r in rows} == {*range(len(texts)), None}


def test_the_rest_works_without_this_part(tmp_path):
    """The folders and the pipeline deleted, the entry module still imports and has the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_names_and_imports():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    for folder, _, files in os.walk(os.path.join(ROOT, "tiltyard")):
        for f in files:
            if f.endswith(".py") and "llm" not in folder:
                assert "tiltyard.llm" not in open(os.path.join(folder, f)).read()
