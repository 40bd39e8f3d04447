import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.operators import retrieval


def brute(docs, queries, k, k1=1.5, b=0.75):
    bags = {d: Counter(t.split()) for d, t in docs}
    n, avg = len(bags), sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(t for c in bags.values() for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for d, c in bags.items():
            if any(t in c for t in text.split()):
                s = sum(m * (math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / avg)) for t, m in Counter(text.split()).items() if t in c)
                scores.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def case(seed, n=400, m=60):
    """Common words that most documents have, so that their idf is negative, and a long tail."""
    rng = random.Random(seed)
    word = lambda: f"w{int(3000 * rng.random() ** 4)}"
    docs = [(f"d{k:04d}", " ".join(["the"] * (rng.random() < 0.8) + ["of"] * (rng.random() < 0.6) * rng.randrange(4) + [word() for _ in range(rng.randrange(1, 60))])) for k in range(n)]
    docs += [("copy", docs[3][1]), ("copy2", docs[3][1]), ("empty", "")]
    queries = [(f"q{k}", " ".join(rng.choice(["the", "of", "the of", ""]).split() + [rng.choice(rng.choice(docs[:n])[1].split() or ["x"]) for _ in range(rng.randrange(0, 7))])) for k in range(m)]
    return docs, queries + [("none", "unknown words"), ("blank", ""), ("common", "the of the")]


def rows(spark, pairs, name):
    return spark.createDataFrame(pairs, f"{name} string, text string").repartition(3)


@pytest.mark.parametrize("block", [4, 1024])
@pytest.mark.parametrize("small", [0, 1 << 30])
def test_bm25_equals_scoring_everything(spark, monkeypatch, block, small):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "SMALL", small)
    docs, queries = case(block)
    got = {}
    for r in retrieval.bm25(rows(spark, docs, "doc"), rows(spark, queries, "query"), 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.doc, r.score))
    want = {q: v for q, v in brute(docs, queries, 4).items() if v}
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=2e-6) for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("worth", [0, 2])
def test_bounds_spare_postings_and_lose_nothing(spark, monkeypatch, worth):
    """With worth 0 every query with a threshold is pruned, however little that spares."""
    monkeypatch.setattr(retrieval, "WORTH", worth)
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    docs, queries = case(9, 900, 80)
    d, q = rows(spark, docs, "doc"), rows(spark, queries, "query")
    index = retrieval._Weighted(d, 1.5, 0.75)
    terms = q.withColumn("q", F.monotonically_increasing_id()).select("q", F.explode(F.split("text", " ")).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf")).join(index.bounds, "term").cache()
    bounded = retrieval._bounded(terms, retrieval._thresholds(index, terms, 3)).where("pruned").cache()
    assert bounded.select("q").distinct().count() > (10 if worth else 40)
    if worth:
        spared = bounded.groupBy("essential").agg(F.sum("df").alias("n")).collect()
        n = {r.essential: r.n for r in spared}
        assert n[True] < n[False]
    best = lambda s: {r.q: r.b for r in s.groupBy("q").agg(F.sort_array(F.collect_list(F.round("score", 5)), asc=False).alias("b")).select("q", F.slice("b", 1, 3).alias("b")).collect()}
    full = best(index.all_scores(bounded))
    assert best(retrieval._pruned_scores(index, bounded)) == full


def test_nothing_to_search(spark):
    docs, queries = case(1)
    none = rows(spark, docs, "doc").limit(0)
    assert retrieval.bm25(none, rows(spark, queries, "query")).collect() == []
    assert retrieval.bm25(rows(spark, docs, "doc"), rows(spark, queries, "query").limit(0)).collect() == []


def in_small_cells(monkeypatch, at_once):
    for name, value in (("FEW", 1), ("SIDE", 50), ("DENSE", 4), ("AT_ONCE", at_once)):
        monkeypatch.setattr(retrieval, name, value)


@pytest.mark.parametrize("at_once", [64, 1 << 18])
def test_bm25_in_cells_equals_scoring_everything(spark, monkeypatch, at_once):
    """Cells smaller than the collection, many copies of a document and of a query, negative terms, and no row but the best leaves a cell."""
    in_small_cells(monkeypatch, at_once)
    docs, queries = case(5)
    docs += [(f"z{k:03d}", docs[7][1]) for k in range(150)] + [(f"y{k:03d}", "the only") for k in range(90)]
    got = {}
    for r in retrieval.bm25(rows(spark, docs, "doc"), rows(spark, queries, "query"), 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.doc, r.score))
    want = {q: v for q, v in brute(docs, queries, 4).items() if v}
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=2e-6) for q in want for a, b in zip(got[q], want[q], strict=True))
    left = retrieval._best_in_cells(rows(spark, docs, "doc"), rows(spark, queries, "query"), 4, F.lit(1.0), F.lit(1.0)).groupBy("query").count().agg(F.max("count")).first()[0]
    assert left < len(docs)


@pytest.mark.parametrize("at_once", [64, 1 << 18])
def test_tfidf_in_cells_equals_scoring_everything(spark, monkeypatch, at_once):
    in_small_cells(monkeypatch, at_once)
    docs, queries = case(6)
    docs += [(f"z{k:03d}", docs[7][1]) for k in range(150)]
    bags = {d: Counter(t.split()) for d, t in docs}
    df = Counter(t for c in bags.values() for t in c)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    want = {}
    for q, text in queries:
        c, scores = Counter(text.split()), []
        for d, b in bags.items():
            both = [t for t in c if t in b]
            if both:
                v, w = {t: n / sum(b.values()) * idf[t] for t, n in b.items()}, {t: c[t] / sum(c.values()) * idf[t] for t in both}
                scores.append((-round(sum(w[t] * v[t] for t in both) / math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in v.values())), 6), d))
        want |= {q: sorted(scores)[:3]} if scores else {}
    got = {}
    for r in retrieval.tfidf(rows(spark, docs, "doc"), rows(spark, queries, "query"), 3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((-r.score, r.doc))
    assert {q: [d for _, d in v] for q, v in got.items()} == {q: [d for _, d in v] for q, v in want.items()}


def test_documents_are_shuffled_to_few_blocks_of_queries():
    """684,000 documents with 125 terms and as many queries with 9: the long rows go to six cells each, not to 42."""
    n = 684_000
    down, across = retrieval._cells(n, 125 * n, n, 9 * n)
    assert (down, across) == (42, 6) and 125 * n * across + 9 * n * down < 1200 * n
    assert retrieval._cells(1, 5, 1, 5) == (1, 1) and retrieval._cells(0, 0, 0, 0)[0] == 1
    assert min(retrieval._cells(1000, 10**5, 1000, 10**4)) >= 1 and retrieval._cells(1000, 10**5, 5000, 10**4)[1] == 32


def test_rows_with_the_same_words_are_scored_once(spark, monkeypatch):
    """Copies of documents and of queries, in any order of their words, meet in no cell, and each has its rows."""
    docs, queries = case(11, 60, 40)
    docs, queries = [x for x in docs if not x[0].startswith(("copy", "empty"))], [x for x in queries if x[1]]
    again = lambda pairs: pairs + [(f"{name}-{c}", " ".join(reversed(text.split()))) for c in range(6) for name, text in pairs]
    sizes, cells = [], retrieval._cells
    monkeypatch.setattr(retrieval, "_cells", lambda n, terms, m, query_terms: sizes.append((n, m)) or cells(n, terms, m, query_terms))
    got = {}
    for r in retrieval.bm25(rows(spark, again(docs), "doc"), rows(spark, again(queries), "query"), 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.doc)
    assert got == {q: [d for d, _ in v] for q, v in brute(again(docs), again(queries), 4).items() if v}
    assert sizes[0][0] <= len(docs) and sizes[0][1] <= len(queries)


def a_cell(seed, n, m, low):
    rng = np.random.default_rng(seed)
    bag = lambda size: np.unique(np.minimum(rng.zipf(1.3, size), 2000))
    terms = [bag(rng.integers(1, 80)) for _ in range(n)], [bag(rng.integers(1, 12)) for _ in range(m)]
    weights = [[rng.uniform(a, 3, len(t)) for t in side] for a, side in zip((low, 0.1), terms, strict=True)]
    names = [f"d{i:05d}" for i in range(n)] + [None] * m, [None] * n + list(range(m))
    return terms, weights, pa.table({"doc": names[0], "query": pa.array(names[1], pa.int64()), "t": terms[0] + terms[1], "v": weights[0] + weights[1]})


@pytest.mark.parametrize(("cosine", "low", "n", "k"), [(False, 0.1, 1500, 5), (True, 0.1, 1500, 5), (False, -0.5, 1500, 5), (True, 0.1, 100, 300), (False, 0.1, 1500, 1)])
def test_single_precision_only_rules_out(monkeypatch, cosine, low, n, k):
    """A cell has the best of all pairs; only a small share of them is scored in doubles."""
    terms, weights, table = a_cell(3, n, 80, low)
    pairs, exact = [], retrieval._Cell.exact
    monkeypatch.setattr(retrieval._Cell, "exact", lambda self, r, c: pairs.append(len(r)) or exact(self, r, c))
    got = {}
    for r in retrieval._best_of_cell(k, cosine)(table).to_pylist():
        got.setdefault(r["query"], []).append((-round(r["score"], 6), r["doc"]))
    for q in range(80):
        w, want = dict(zip(terms[1][q], weights[1][q], strict=True)), []
        for d in range(n):
            both = [(w[t], v) for t, v in zip(terms[0][d], weights[0][d], strict=True) if t in w]
            if both:
                s = sum(a * b for a, b in both)
                want.append((-round(s / math.sqrt(sum(a * a for a, _ in both)) if cosine else s, 6), f"d{d:05d}"))
        assert sorted(got.get(q, []))[:k] == sorted(want)[:k]
    if k < n:
        assert 0 < sum(pairs) < 80 * 4 * (k + 1)


def test_many_ties_are_cut_by_name():
    """All documents tie: a query's first k come back from a cell, not all."""
    table = pa.table({"doc": [f"d{i:05d}" for i in range(1200)] + [None] * 2, "query": pa.array([None] * 1200 + [0, 1], pa.int64()), "t": [[7]] * 1202, "v": [[0.5]] * 1202})
    out = retrieval._best_of_cell(5, False)(table).to_pylist()
    assert sorted((r["query"], r["doc"]) for r in out) == [(q, f"d{i:05d}") for q in (0, 1) for i in range(5)]
