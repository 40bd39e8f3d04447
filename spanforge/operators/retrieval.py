"""Lexical retrieval: sentences inside a context by TF-IDF, and collections by BM25 and TF-IDF.

Sentences are scored by joins and aggregates over exploded terms. A table of queries meets a collection in
cells: a bounded block of documents and one of queries are multiplied inside a task, and only a query's best
documents of a cell leave it, so no row is shuffled for a shared term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as X
from spanforge.runtime import new_path, ready, saved, size_of


def _terms(x: Column) -> Column:
    """Lower-cased words of two word characters or more, then their pairs."""
    w = F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b(\w\w+)\b"))
    pairs = lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    return X.bound(w, lambda t: F.concat(t, pairs(t)))


def best_sentence(examples: DataFrame) -> DataFrame:
    """(qid, sent_ix, prediction): the context's sentence with the best TF-IDF cosine to the question.

    Fitted on a context's sentences and the question: idf ln((1 + n) / (1 + df)) + 1, raw counts, L2
    norm. The first one wins ties; no sentence gives ''.
    """
    s = examples.select("qid", "question", X.sentences(F.col("context")).alias("sents"))
    units = s.select("qid", F.size("sents").alias("n"), F.posexplode(F.concat("sents", F.array("question"))).alias("ix", "text"))
    tf = units.select("qid", "n", "ix", F.explode(_terms(F.col("text"))).alias("term")).groupBy("qid", "n", "ix", "term").agg(F.count(F.lit(1)).alias("tf"))
    per_term, per_unit = Window.partitionBy("qid", "term"), Window.partitionBy("qid", "ix")
    idf = F.log((1 + F.col("n") + 1) / (1 + F.count(F.lit(1)).over(per_term))) + 1
    v = tf.withColumn("v", F.col("tf") * idf)
    v = v.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(per_unit)))
    q = v.where("ix = n").select("qid", "term", F.col("v").alias("qv"))
    sims = v.where("ix < n").join(q, ["qid", "term"]).groupBy("qid", "ix").agg(F.round(F.sum(F.col("v") * F.col("qv")), 9).alias("sim"))
    best = sims.groupBy("qid").agg(F.max(F.struct("sim", (-F.col("ix")).alias("k"))).alias("b"))
    ix = F.coalesce(-F.col("b.k"), F.lit(0))
    return s.join(best, "qid", "left").select("qid", ix.alias("sent_ix"), F.coalesce(F.get("sents", ix), F.lit("")).alias("prediction"))


def _top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Postings of a block on average, impact levels of a term, seed postings of a query, and how much of its
#: postings a query may spare at least to be worth the bounds.
BLOCK, LEVELS, SEEDS, WORTH = 1024, 16, 64, 2
#: Scores are rounded to six digits before they are ranked, so bounds keep that much slack.
SLACK = 1e-5
#: Bytes of a weighted index that is broadcast to the queries in place of a shuffle of their scores.
SMALL = 32 << 20


class _Weighted:
    """An index of (term, d, part): what a term adds to a document's score; d numbers the documents, bounds are per term."""

    def __init__(self, docs: DataFrame, k1: float, b: float):
        spark = docs.sparkSession
        words = F.filter(F.split(X.legacy_normalize(F.col("text")), " "), lambda t: t != "")
        self.docs = saved(docs.select("doc", words.alias("words")).withColumn("d", F.monotonically_increasing_id()), "documents")
        tf = self.docs.select("d", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("d", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
        tf = saved(tf, "postings")
        total = self.docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words"))
        total = total.select("n", F.try_divide("words", "n").alias("avgdl"))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
        path = new_path(spark, "weighted")
        tf.join(df, "term").crossJoin(F.broadcast(total)).select("term", "d", part.alias("part")).write.parquet(path)  # one row
        self.rows = spark.read.schema("term string, d bigint, part double").parquet(path)
        self.small = size_of(spark, path) <= SMALL
        self.bounds = saved(self.rows.groupBy("term").agg(F.max("part").alias("top"), F.count(F.lit(1)).alias("df")), "bounds")

    def blocks(self) -> DataFrame:
        """(term, best, postings): a term's postings by level of their part, in pieces of a bounded size, with the largest part of each."""
        share = F.when(F.col("top") > 0, F.least(F.lit(LEVELS - 1), F.floor(F.greatest(F.col("part"), F.lit(0.0)) / F.col("top") * LEVELS))).otherwise(F.lit(0))
        piece = F.pmod(F.xxhash64("d"), F.greatest(F.lit(1), F.ceil(F.col("df") / BLOCK)))
        rows = self.rows.join(self.bounds, "term").select("term", share.alias("level"), piece.alias("piece"), "d", "part")
        return rows.groupBy("term", "level", "piece").agg(F.max("part").alias("best"), F.collect_list(F.struct("d", "part")).alias("postings")).select("term", "best", "postings")

    def exact(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """(q, d, score): what the terms (q, term, qtf) add to the score of each pair."""
        return pairs.join(terms.select("q", "term", "qtf"), "q").join(self.rows, ["term", "d"]).groupBy("q", "d").agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))

    def all_scores(self, terms: DataFrame) -> DataFrame:
        """(q, d, score) of every document that shares a term with a query."""
        if self.small:  # scores of a query then stay in its partition
            hits = terms.repartition("q").join(F.broadcast(self.rows), "term")
        else:
            hits = terms.join(self.rows, "term")
        return hits.groupBy("q", "d").agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))


def _thresholds(index: _Weighted, terms: DataFrame, k: int) -> DataFrame:
    """(q, theta): the k-th best exact score among documents with the query's rarest terms; no row where there are too few."""
    rarest = Window.partitionBy("q").orderBy("df", "term")
    seeds = terms.withColumn("before", F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where((F.col("before") + F.col("df") <= SEEDS) | ((F.col("before") == 0) & (F.col("df") <= BLOCK)))
    partial = seeds.join(index.rows, "term").groupBy("q", "d").agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))
    likely = partial.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))).where(F.col("r") <= 2 * k).select("q", "d")
    ranked = index.exact(likely, terms).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
    return ranked.where(F.col("r") == k).select("q", F.col("score").alias("theta"))


def _bounded(terms: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The terms with bound (the most one adds), all bounds' sum, whether a document needs the term or a rarer kind to reach
    theta (essential), the bounds' sum of those it doesn't need, and whether the query is worth it (pruned).

    Terms rise by their bounds; those whose bounds add up to less than theta can't bring a document there by
    themselves. A negative term adds 0 at most, where it is missing.
    """
    rising, whole = Window.partitionBy("q").orderBy("bound", "term"), Window.partitionBy("q")
    t = terms.join(thresholds, "q", "left").withColumn("bound", F.greatest(F.lit(0.0), F.col("top") * F.col("qtf")))
    t = t.withColumns({"total": F.sum("bound").over(whole), "reach": F.sum("bound").over(rising)})
    t = t.withColumn("essential", F.coalesce(F.col("reach") >= F.col("theta") - SLACK, F.lit(True)))
    needed = F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).over(whole)
    others = F.sum(F.when(F.col("essential"), 0).otherwise(1)).over(whole)
    rest = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))).over(whole), F.lit(0.0))
    return t.withColumns({"rest": rest, "pruned": F.col("theta").isNotNull() & (WORTH * needed * (1 + others) < F.sum("df").over(whole))})


def _pruned_scores(index: _Weighted, terms: DataFrame) -> DataFrame:
    """(q, d, score): exact for every document that can be among the best; others may be missing."""
    at_least = F.col("theta") - SLACK
    essential = terms.where("essential").select("q", "term", "qtf", "bound", "total", "rest", "theta")
    blocks = essential.join(index.blocks(), "term").where(F.col("best") * F.col("qtf") + F.col("total") - F.col("bound") >= at_least)
    hits = blocks.select("q", "qtf", "rest", "theta", F.inline("postings"))
    partial = hits.groupBy("q", "d", "rest", "theta").agg(F.sum(F.col("part") * F.col("qtf")).alias("s")).where(F.col("s") + F.col("rest") >= at_least)
    partial = saved(partial.select("q", "d", "s"), "survivors")
    more = index.exact(partial, terms.where("not essential"))
    return partial.join(more, ["q", "d"], "left").select("q", "d", (F.col("s") + F.coalesce("score", F.lit(0.0))).alias("score"))


def _bounded_search(docs: DataFrame, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query, doc, score) of a few queries: common terms' postings are only read where the bounds leave a choice."""
    index = _Weighted(docs, k1, b)
    asked = saved(queries.select("query", "text").withColumn("q", F.monotonically_increasing_id()), "queries")
    terms = asked.select("q", F.explode(F.split(X.legacy_normalize(F.col("text")), " ")).alias("term")).where("term <> ''").groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = saved(terms.join(index.bounds, "term"), "terms")
    bounded = saved(_bounded(terms, _thresholds(index, terms, k)), "bounded")
    scores = index.all_scores(bounded.where("not pruned"))
    some = bounded.where("pruned")
    if not some.isEmpty():
        scores = scores.unionByName(_pruned_scores(index, some))
    scores = scores.withColumn("score", F.round("score", 6))
    # first by number, so that names are joined to few rows; all that tie with the last place stay until then
    best = scores.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k).drop("r")
    return best.join(index.docs.select("d", "doc"), "d").join(asked.select("q", "query"), "q").select("query", "doc", "score")


#: Queries up to which a search goes by bounds over blocks of postings.
FEW = 64
#: Documents, queries (these are short) and terms of a cell's side on average, cells to aim at, and terms that a cell multiplies as a dense matrix.
SIDE, QUERIES, SIDE_TERMS, CELLS, DENSE = 16384, 131072, 4 << 20, 32, 512
#: Scores and postings that are worked on at once inside a cell, and postings a pair from which a term is dense, as one over so many.
AT_ONCE, OFTEN = 1 << 20, 400
#: Groups of documents whose best scores bound a query's k-th best, and candidates a place beyond which a query is scored in doubles throughout.
GROUPS, MANY = 256, 64


def _postings(starts: np.ndarray, n: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entries, their numbers of postings, postings) of entries with n postings each from their starts on, a bounded number at once."""
    before = np.cumsum(n) - n
    cuts = np.r_[0, np.flatnonzero(np.diff(before // at_once)) + 1, len(n)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            part = slice(low, high)
            at = np.repeat(starts[part] - (before[part] - before[low]), n[part])
            at += np.arange(len(at))
            yield part, n[part], at


class _Cell:
    """Documents and queries of a cell, both numbered, with their terms (numbers from 0 that a query has) and weights."""

    def __init__(self, docs: pa.Table, queries: pa.Table, k: int, cosine: bool, dense: int, at_once: int):
        def side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t, v = rows["t"].combine_chunks(), rows["v"].combine_chunks()
            return np.repeat(np.arange(len(t)), t.value_lengths().to_numpy(zero_copy_only=False)), t.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)

        self.n, self.m, self.k, self.cosine, self.at_once = docs.num_rows, queries.num_rows, k, cosine, at_once
        (d, dt, dv), (q, qt, qv) = side(docs), side(queries)
        terms, qt = np.unique(qt, return_inverse=True)
        at = np.minimum(np.searchsorted(terms, dt), len(terms) - 1)
        both = terms[at] == dt if len(terms) else np.zeros(len(dt), bool)
        d, dt, dv = d[both], at[both], dv[both]
        self.n_terms = len(terms)
        order = np.argsort(d * self.n_terms + dt, kind="stable")  # a document's terms rise
        self.key, self.value = (d * self.n_terms + dt)[order], dv[order]
        self.first = np.searchsorted(d, np.arange(self.n + 1))
        order = np.argsort(dt, kind="stable")  # postings by term
        self.d, self.v, dt = d[order], dv[order], dt[order]
        self.df = np.bincount(dt, minlength=len(terms))
        self.start = np.cumsum(self.df) - self.df
        self.q, self.qt, self.qv = q, qt, qv
        work = self.df * np.bincount(qt, minlength=len(terms))
        often = np.argsort(-work, kind="stable")[:dense]
        self.often = often[work[often] * OFTEN > self.n * self.m]
        self.place = np.full(len(terms), -1)
        self.place[self.often] = np.arange(len(self.often))
        self.common = self.place[dt] >= 0
        self.row = self.place[dt[self.common]]
        self.positive = not len(dv) or bool(dv.min() > 0 and (not len(qv) or qv.min() > 0))
        top = np.zeros(len(terms))
        np.maximum.at(top, dt, np.abs(self.v))
        self.size = np.bincount(q, np.abs(qv) * top[qt], self.m)  # no sum of a query is larger
        self.n_words = np.bincount(q, minlength=self.m)
        self.largest = np.zeros(self.m)
        np.maximum.at(self.largest, q, np.abs(qv))

    def matrices(self, kind: type, wide: int) -> tuple[np.ndarray, np.ndarray]:
        matrix, held = np.zeros((len(self.often), wide), kind), np.zeros((len(self.often), wide), kind)
        matrix[self.row, self.d[self.common]], held[self.row, self.d[self.common]] = self.v[self.common], 1
        return matrix, held

    def doubles(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score) of the best of some queries, by all documents' scores in doubles."""
        n, k = self.n, self.k
        matrix, held = self.matrices(float, n)
        step = max(1, self.at_once // n)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            size = len(some)
            a, b = np.searchsorted(self.q, some), np.searchsorted(self.q, some + 1)
            row = np.repeat(np.arange(size), b - a)
            at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(len(row))
            term, w = self.qt[at], self.qv[at]
            big = self.place[term] >= 0
            dense, there = np.zeros((size, len(self.often))), np.zeros((size, len(self.often)))
            dense[row[big], self.place[term[big]]] = w[big]
            there[row[big], self.place[term[big]]] = w[big] * w[big] if self.cosine else 1
            row, term, w = row[~big], term[~big], w[~big]
            score, met = dense @ matrix, there @ held
            for part, times, p in _postings(self.start[term], self.df[term], self.at_once):
                cell = np.repeat(row[part] * n, times) + self.d[p]
                score += np.bincount(cell, np.repeat(w[part], times) * self.v[p], size * n).reshape(size, n)
                met += np.bincount(cell, np.repeat(w[part] * w[part], times) if self.cosine else None, size * n).reshape(size, n)
            hit = met > 0
            if self.cosine:
                score /= np.sqrt(np.where(hit, met, 1.0), out=met)
            score[~hit] = -np.inf
            last = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(size, -np.inf)
            r, c = np.nonzero(hit & (score >= last[:, None] - SLACK))
            yield some[r], c, score[r, c]

    def best(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score) of the queries' best.

        All sums are taken in single precision first. A query's k-th best group of documents has k that reach its
        best, so what lies below by more than the rounding errors can't be among the best. The others, hardly more than k,
        are scored in doubles. A sum of 0 may be a document without a shared term or one with negative terms: where
        these would be among the best, and where too many tie, the query is scored in doubles throughout.
        """
        k, cosine = self.k, self.cosine
        if cosine and not self.positive:  # squares would hide the sign
            yield from self.doubles(np.arange(self.m))
            return
        wide = -(-self.n // GROUPS) * GROUPS
        matrix, held = self.matrices(np.float32, wide)
        value, step, left = self.v.astype(np.float32), max(1, min(self.m, self.at_once // wide)), []
        if cosine:  # no document has a norm of 0
            held = np.vstack([held, np.full(wide, 1e-30, np.float32)])
        scores, norms = np.empty((step, wide), np.float32), np.empty((step, wide), np.float32)
        for low in range(0, self.m, step):
            size = min(step, self.m - low)
            a, b = np.searchsorted(self.q, [low, low + size])
            row, term, w = self.q[a:b] - low, self.qt[a:b], self.qv[a:b].astype(np.float32)
            if cosine:
                w /= self.largest[low + row].astype(np.float32)  # a query's scale doesn't change its cosines
            big = self.place[term] >= 0
            dense = np.zeros((size, len(self.often)), np.float32)
            dense[row[big], self.place[term[big]]] = w[big]
            score, met = np.matmul(dense, matrix, out=scores[:size]), norms[:size]
            if cosine:
                np.matmul(np.hstack([dense * dense, np.ones((size, 1), np.float32)]), held, out=met)
            row, term, w = row[~big], term[~big], w[~big]
            for part, times, p in _postings(self.start[term], self.df[term], self.at_once):
                cell = np.repeat(row[part] * wide, times)
                cell += self.d[p]
                np.add.at(score.ravel(), cell, np.repeat(w[part], times) * value[p])
                if cosine:
                    np.add.at(met.ravel(), cell, np.repeat(w[part] * w[part], times))
            words = self.n_words[low : low + size]
            if cosine:  # squares of the cosines
                score *= score
                score /= met
            groups = score.reshape(size, wide // GROUPS, GROUPS).max(axis=1)
            last = np.partition(groups, GROUPS - k, axis=1)[:, GROUPS - k].astype(float) if GROUPS >= k else np.zeros(size)
            if cosine:
                least = np.maximum(np.sqrt(last) - SLACK, 0) ** 2 * np.maximum(1 - (words + 8) * 2.0**-20, 0)
            elif self.positive:
                least = np.maximum(last * np.maximum(1 - (words + 8) * 2.0**-22, 0) - SLACK, 0)
            else:
                least = last - (words + 8) * 2.0**-22 * self.size[low : low + size] - SLACK
            bar = np.nextafter(least.astype(np.float32), np.float32(-1))
            if self.positive:
                bar = np.maximum(bar, np.finfo(np.float32).smallest_subnormal)
            else:
                bar[least <= 0] = np.inf
            r, g = np.nonzero(groups >= bar[:, None])
            e, c = np.nonzero(score.reshape(size, -1, GROUPS)[r, :, g] >= bar[r, None])
            r, c = r[e], c * GROUPS + g[e]
            found = np.bincount(r, minlength=size)
            other = (np.isinf(bar)) | (found > MANY * k)
            if other.any():
                left.append(low + np.flatnonzero(other))
                r, c = r[~other[r]], c[~other[r]]
            if len(r):
                yield low + r, c, self.exact(low + r, c)
        if left:
            yield from self.doubles(np.concatenate(left))

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document that share a term."""
        docs, c = np.unique(c, return_inverse=True)
        n = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, value = self.key[at], self.value[at]
        a, b = np.searchsorted(self.q, r), np.searchsorted(self.q, r + 1)
        pair = np.repeat(np.arange(len(r)), b - a)
        at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(len(pair))
        wanted, w = docs[c[pair]] * self.n_terms + self.qt[at], self.qv[at]
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        w = np.where(key[at] == wanted, w, 0.0)
        score = np.bincount(pair, w * value[at], len(r))
        return score / np.sqrt(np.bincount(pair, w * w, len(r))) if self.cosine else score


def _best_of_cell(k: int, cosine: bool):
    """The function of a cell: rows of documents and queries with their terms (distinct numbers) and weights to (query, doc, score)."""

    def best(rows: pa.Table) -> pa.Table:
        docs, queries = rows.filter(rows["doc"].is_valid()), rows.filter(rows["query"].is_valid())
        schema = pa.schema([rows.schema.field("query"), rows.schema.field("doc"), ("score", pa.float64())])
        out: list[pa.Table] = []
        if not docs.num_rows or not queries.num_rows:
            return schema.empty_table()
        docs = docs.sort_by("doc")  # of documents that tie the first are kept
        for r, c, s in _Cell(docs, queries, k, cosine, DENSE, AT_ONCE).best():
            if len(r) > 8 * k * len(np.unique(r)):  # many tie: of equal scores the first k documents do
                near = np.round(s, 9)
                o = np.lexsort((c, near, r))
                new = np.r_[True, (np.diff(r[o]) != 0) | (np.diff(near[o]) != 0)]
                o = o[np.arange(len(o)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]
                r, c, s = r[o], c[o], s[o]
            out.append(pa.table([queries["query"].take(pa.array(r)), docs["doc"].take(pa.array(c)), pa.array(s)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return best


def _cells(n: int, terms: int, m: int, query_terms: int) -> tuple[int, int]:
    """Blocks of n documents and of m queries. Each document is shuffled to every block of queries, so these are as few as memory and cores allow."""
    down = max(1, math.ceil(n / SIDE), math.ceil(terms / SIDE_TERMS))
    return down, max(1, math.ceil(m / QUERIES), math.ceil(query_terms / SIDE_TERMS), min(math.ceil(CELLS / down), math.ceil(m / FEW)))


def _best_in_cells(docs: DataFrame, queries: DataFrame, k: int, part: Column, weight: Column, cosine: bool = False) -> DataFrame:
    """(query, doc, score) of each query's best documents, k or more, where it has them: sums of part * weight over shared terms.

    part: of tf, len, df, n (documents) and avgdl; weight: of qtf, words (the query's), df and n. cosine divides by the
    norm of the document's parts and by that of the query's weights of shared terms. Scores have six digits.
    Documents with the same words are scored once, as are queries; of these documents the first k come back, since no
    other can be among the best.
    """
    ready(docs.sparkSession)
    words = F.filter(F.split(X.legacy_normalize(F.col("text")), " "), lambda t: t != "")
    bag = F.sha2(F.concat_ws(" ", F.array_sort("words")), 256)
    d = saved(docs.select("doc", words.alias("words")).withColumn("d", F.monotonically_increasing_id()), "words")
    named = saved(queries.select("query", words.alias("words")).where("size(words) > 0").withColumn("bag", bag), "words")
    q = saved(named.groupBy("bag").agg(F.first("words").alias("words")).withColumn("d", F.monotonically_increasing_id()), "words")
    total = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("all")).select("n", F.try_divide("all", "n").alias("avgdl"))
    asked = q.select(F.explode("words").alias("term")).distinct().withColumn("asked", F.lit(True))
    df = d.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = saved(df.join(asked, "term", "left").crossJoin(F.broadcast(total)).withColumn("t", F.monotonically_increasing_id()), "terms")  # total is one row
    kept = d.withColumn("bag", bag).withColumn("copy", F.row_number().over(Window.partitionBy("bag").orderBy("doc"))).where(F.col("copy") <= k)
    kept = kept.withColumn("same", F.collect_list("doc").over(Window.partitionBy("bag"))).where("copy = 1").withColumn("same", F.when(F.size("same") > 1, F.col("same")))
    tf = kept.select("d", "doc", "same", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("d", "doc", "same", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    vector = lambda rows, *keys: rows.groupBy(*keys).agg(F.collect_list(F.when(F.col("asked"), F.struct("t", "v"))).alias("x"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dv = vector(tf.join(terms, "term").withColumn("v", part), "d", "doc", "same").where("size(x) > 0")
    dv = saved(dv.select("doc", "same", F.col("x.t").alias("t"), (F.transform("x.v", lambda v: v / F.col("norm")) if cosine else F.col("x.v")).alias("v")), "vectors")
    qt = q.select("d", F.size("words").alias("words"), F.explode("words").alias("term")).groupBy("d", "words", "term").agg(F.count(F.lit(1)).alias("qtf"))
    qv = saved(vector(qt.join(terms, "term").withColumn("v", weight), "d").select(F.col("d").alias("query"), F.col("x.t").alias("t"), F.col("x.v").alias("v")), "vectors")

    n, m = [x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("terms")).first() for x in (dv, qv)]
    down, across = _cells(n.n, n.terms, m.n, m.terms)
    block = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = lambda x, key: F.lit(None).cast(x.schema[key].dataType).alias(key)
    sides = dv.select(block("doc", down).alias("i"), each(across).alias("j"), "doc", none(qv, "query"), "t", "v")
    sides = sides.unionByName(qv.select(each(down).alias("i"), block("query", across).alias("j"), none(dv, "doc"), "query", "t", "v"))
    kind = {c: x.schema[c].dataType.simpleString() for x, c in ((qv, "query"), (dv, "doc"))}
    schema = ", ".join(f"{c} {t}" for c, t in kind.items()) + ", score double"
    cells = sides.repartition(min(4 * down * across, 4000), "i", "j").groupBy("i", "j")  # a number that is given is not coalesced: cells are work, not bytes
    scores = cells.applyInArrow(_best_of_cell(k, cosine), schema).withColumn("score", F.round("score", 6))
    best = _top(scores, k).drop("rank").join(dv.select("doc", F.explode("same").alias("copy")), "doc", "left").select("query", F.coalesce("copy", "doc").alias("doc"), "score")
    named = named.select("query", "bag").join(q.select("bag", F.col("d").alias("number")), "bag").select("query", "number")
    return named.join(best.withColumnRenamed("query", "number"), "number").select("query", "doc", "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank): idf ln(N - df + .5) - ln(df + .5), which may be negative; repeated query terms count.

    Documents that share no term with a query would score 0 and are not listed. The result is that of scoring
    everything. A table of queries does so in cells. For a few queries one whose common terms can't decide alone looks
    only at blocks of its other terms' postings whose largest part may still reach the k-th best score found so far.
    """
    if queries.limit(FEW + 1).count() <= FEW:
        return _top(_bounded_search(docs, queries, k, k1, b), k)
    part = (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return _top(_best_in_cells(docs, queries, k, part, F.col("qtf").cast("double")), k)


def tfidf(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, doc, score, rank): tf / length, idf ln((N + 1) / (df + 1)) + 1; the query's norm only counts terms of the document."""
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return _top(_best_in_cells(docs, queries, k, F.col("tf") / F.col("len") * idf, F.col("qtf") / F.col("words") * idf, cosine=True), k)


def span_around_keywords(sentence: Column, question: Column, before: int = 3, after: int = 5, without: int = 10) -> Column:
    """Words from a few before the first question word in the sentence to a few after the last; without any, the first ones."""
    words = F.filter(F.split(sentence, " "), lambda t: t != "")
    keys = F.split(X.legacy_normalize(question), " ")

    def cut(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda t, i: F.when(F.array_contains(keys, X.legacy_normalize(t)), i)), lambda i: i.isNotNull())
        return F.when(F.size(at) == 0, F.concat_ws(" ", F.slice(w, 1, without))).otherwise(F.concat_ws(" ", F.slice(w, F.greatest(F.array_min(at) - before, F.lit(0)) + 1, F.array_max(at) + after + 1 - F.greatest(F.array_min(at) - before, F.lit(0)))))

    return X.bound(words, cut)


def bm25_answers(examples: DataFrame, least: float = 0.01) -> DataFrame:
    """(qid, prediction): the context's best sentence by BM25, or by TF-IDF where BM25 has less than `least`."""
    s = examples.select("qid", "question", F.posexplode(X.legacy_sentences(F.col("context"))).alias("ix", "text"))
    t = s.select("qid", "ix", F.explode(F.split(X.legacy_normalize(F.col("text")), " ")).alias("term")).where("term <> ''").groupBy("qid", "ix", "term").agg(F.count(F.lit(1)).alias("tf"))
    per, unit = Window.partitionBy("qid", "term"), Window.partitionBy("qid", "ix")
    n = s.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    v = t.withColumns({"df": F.count(F.lit(1)).over(per), "len": F.sum("tf").over(unit)}).join(n, "qid")
    v = v.withColumn("avgdl", F.sum("tf").over(Window.partitionBy("qid")) / F.col("n"))
    q = examples.select("qid", F.explode(F.split(X.legacy_normalize(F.col("question")), " ")).alias("term")).where("term <> ''").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    bm = idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avgdl"))) * F.col("qtf")
    ti = F.col("tf") / F.col("len") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) * F.col("qtf")
    score = v.join(q, ["qid", "term"]).groupBy("qid", "ix").agg(F.sum(bm).alias("bm"), F.sum(ti).alias("ti"))
    best = score.groupBy("qid").agg(F.max(F.struct("bm", (-F.col("ix")).alias("k"))).alias("b"), F.max(F.struct("ti", (-F.col("ix")).alias("k"))).alias("t"))
    pick = F.coalesce(-F.when(F.col("b.bm") >= least, F.col("b.k")).otherwise(F.col("t.k")), F.lit(0))
    out = examples.select("qid", "question", X.legacy_sentences(F.col("context")).alias("sents")).join(best, "qid", "left")
    return out.select("qid", F.coalesce(span_around_keywords(F.get("sents", pick), F.col("question")), F.lit("")).alias("prediction"))
