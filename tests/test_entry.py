import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from spanforge.functions import text as X
from spanforge.operators import diagnosis, scoring, spans, stress
from spanforge.sources import corpora
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=env, check=True, timeout=120)


def test_config_and_review_sheets(spark, tmp_path):
    assert corpora.read_config(spark, str(tmp_path / "none")) == {}
    corpora.write_config(spark, {"a": [1, "é"]}, str(tmp_path / "c"))
    assert corpora.read_config(spark, str(tmp_path / "c")) == {"a": [1, "é"]}
    (tmp_path / "r.csv").write_text("qid,subset,cau_hoi,dap_an_goc,thay_doi,context_moi,tieu_chi,nguoi_1,nguoi_2,ghi_chu\na,E5,q,x,,c,,ok,loai,n\n")
    items = spark.createDataFrame([("a", "E5", "q", ["x", "y"], "", "c"), ("b", "E5", "q", ["x"], "", "c")], "qid string, subset string, question string, answers array<string>, note string, context string")
    got = {r.qid: r for r in corpora.with_verdicts(items, corpora.read_reviews(spark, str(tmp_path / "r.csv"))).collect()}
    assert (got["a"].dap_an_goc, got["a"].nguoi_2, got["b"].nguoi_1) == ("x | y", "loai", "")
    assert corpora.read_reviews(spark, None).count() == 0
    orig = spark.createDataFrame([("a",), ("a-orig",), ("b",)], "qid string")
    assert [r.qid for r in diagnosis.rejected(orig, corpora.read_reviews(spark, str(tmp_path / "r.csv"))).collect()] == ["b"]


def test_result_files_and_older_predictions(spark, tmp_path):
    assert corpora.read_result(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "r.json").write_text('{"a": {"b": {"em": 3.5}}}')
    row = corpora.read_result(spark, str(tmp_path / "r.json"), "a struct<b: struct<em: double, f1: double>>")
    assert row.select(X.dig(F.col("a"), "b", "em").alias("x"), X.dig(F.col("a"), "b", "f1").alias("y")).first() == (3.5, None)
    (tmp_path / "p.json").write_text('[{"id": "1", "prediction_text": "x", "confidence": 0.5}, {"id": "2"}, {"id": "9", "prediction_text": "z"}]')
    (tmp_path / "q.json").write_text('[{"id": "1", "question": "?", "answers": {"text": ["x", "y"], "answer_start": [0, 1]}}, {"id": "2", "context": "own", "is_impossible": true, "answers": {"text": [], "answer_start": []}}, {"id": "3", "answers": {"text": ["w"]}}]')
    contexts = spark.createDataFrame([("1", "x y")], "qid string, context string")
    got = corpora.read_legacy_predictions(spark, str(tmp_path / "p.json"), str(tmp_path / "q.json"), contexts).orderBy("qid").collect()
    assert [tuple(r) for r in got] == [("1", "x", 0.5, ["x", "y"], False, "?", "x y"), ("2", "", 0.0, [], True, "", "own")]


def test_pairs_are_encoded_and_cut(spark):
    rows = spark.createDataFrame([("q", "a b", [("x", 0, 1), ("y", 2, 3), ("z", 4, 5)])], "qid string, question string, words array<struct<tok: string, s: int, e: int>>")
    r = spans.encode_pairs(rows, lambda t: [ord(t), 9], max_length=12).first()
    assert r.input_ids == [0, 97, 9, 98, 9, 2, 2, 120, 9, 121, 9, 2] and sum(r.attention_mask) == 12
    assert [o and (o["s"], o["e"]) for o in r.offsets] == [None] * 7 + [(0, 1)] * 2 + [(2, 3)] * 2 + [None]
    assert spans.encode_pairs(rows, lambda t: [1], max_length=16).first().input_ids[-5:] == [1] * 5


def test_timed_predictor_and_source_scores(spark):
    rows = spark.createDataFrame([("q", "?", "c")], "qid string, question string, context string")
    r = spans.timed_predictions(rows, lambda q, c: c + q).first()
    assert r.prediction == "c?" and r.seconds >= 0
    items = scoring.score_items(spark.createDataFrame([("s", "q", "c", ["c"])], "system string, qid string, prediction string, golds array<string>"))
    sliced = rows.select(F.lit("slice").alias("role"), F.lit("E4").alias("subset"), F.col("qid").alias("source_qid"))
    assert scoring.source_scores(items, sliced).first().em == 100
    assert scoring.legacy_scores(items).first().f1 == 100
    assert stress.SIZES["E1a"] is None


def test_the_rest_runs_without_the_corpus_operators(tmp_path):
    """With both llm folders and the pipeline deleted all other tests can be collected, and those of the functions and of this module's first queries pass."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=copy, capture_output=True, text=True, timeout=900, env=os.environ | {"PYTHONPATH": str(copy)})
    found = run("tests", "--collect-only")
    assert found.returncode == 0 and "test_oracle" in found.stdout and "llm" not in found.stdout, found.stdout[-2000:]
    done = run("tests/test_functions.py", "tests/test_located.py", "tests/test_entry.py::test_entry_gives_rows", "tests/test_oracle.py::test_same_rows[corpus_scores]", "tests/test_oracle.py::test_same_rows[sibling_similarity]", "-x")
    assert done.returncode == 0, done.stdout[-2000:]
