import random

from pyspark.sql import functions as F

from spanforge.plans import fixtures


def test_passages_are_found_whatever_stands_beside_them(spark, tmp_path, monkeypatch):
    """Short passages, glued ones, other white space, repeats, and passages of one word, as a search of all pairs finds them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 30) for _ in range(3)] + ["two  spaces here", "a\nline break", " lead and trail ", "x", ""]
    docs = []
    for k in range(150):
        text = " ".join(word() for _ in range(rng.randrange(0, 60)))
        for p in rng.sample(passages, 3):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", " ", "(", "\n", '"']) + p + rng.choice(["", " ", ")", ".", '"']) + text[at:]
        docs.append((k, text))
    docs.append((999, None))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(d, i, t.index(p)) for d, t in docs if t for i, p in enumerate(passages) if p and p in t}
    for most in (4096, 0):
        monkeypatch.setattr(fixtures, "IN_ROW", most)
        got = [(r.doc_id, r.item_id, r.answer_start) for r in fixtures.located(spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 450


def test_no_passages(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ""), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = fixtures.located(spark, str(tmp_path))
    assert found.collect() == [] and found.select(F.col("answer_start") + 1, "item_id", "context").columns
