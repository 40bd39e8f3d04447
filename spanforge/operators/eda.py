"""Exploration of a corpus: summaries, histograms, sibling questions, edits and token changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as X
from spanforge.operators import threshold


def order_stats(rows: DataFrame, value: str) -> DataFrame:
    """(n, mean, median, p05, p95, max): percentiles are the elements at int(n * p), from counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))
    r = threshold.running_sums(counts, "v", ["c"]).crossJoin(F.broadcast(total))  # one row
    at = lambda k: F.min(F.when(F.col("c") > k, F.col("v")))
    p = lambda q: at(F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return r.agg(F.max("n").alias("n"), F.round(F.max(F.col("s") / F.col("n")), 2).alias("mean"), middle.alias("median"), p(0.05).alias("p05"), p(0.95).alias("p95"), F.max("v").alias("max"))


def histogram(rows: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """(bin, n) over half-open edges, empty bins included; the last one is open."""
    v = F.col(value)
    bins = list(zip(edges[:-1], edges[1:], strict=True))
    one = rows.agg(*[F.count_if((v >= lo) & (v < hi)).alias(f"b{k}") for k, (lo, hi) in enumerate(bins)])
    label = lambda lo, hi: f"{lo}-{hi - 1}" if hi < 10**6 else f"{lo}+"
    return one.select(F.inline(F.array(*[F.struct(F.lit(label(*b)).alias("bin"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bins)])))


def edit_types(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("edit", X.edit_type(F.col("question"), F.col("sibling"))).groupBy("edit").agg(F.count(F.lit(1)).alias("n"))


def token_changes(pairs: DataFrame, top: int = 25, least: float = 0.5) -> DataFrame:
    """(kind, token, n): the most frequent added and removed tokens over similar pairs; ties in code-point order."""
    p = pairs.where(F.col("jaccard") >= least).select(X.tokens(F.col("question")).alias("i"), X.tokens(F.col("sibling")).alias("s"))
    both = F.concat(F.transform(X.multiset_minus(F.col("i"), F.col("s")), lambda t: F.struct(F.lit("added").alias("kind"), t.alias("token"))), F.transform(X.multiset_minus(F.col("s"), F.col("i")), lambda t: F.struct(F.lit("removed").alias("kind"), t.alias("token"))))
    return most_common(p.select(F.inline(both)), ["kind"], "token", top)


def most_common(rows: DataFrame, by: list[str], value: str, top: int) -> DataFrame:
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value) if by else Window.orderBy(F.desc("n"), value)
    return n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")


def label_noise(examples: DataFrame) -> DataFrame:
    """Answers whose offset doesn't fit, and those that begin or end inside a word."""
    a = F.get("answers", F.lit(0))
    e = F.col("answer_start") + F.length(a)
    fits = F.substring("context", F.col("answer_start") + 1, F.length(a)) == a
    start = fits & X.is_letter_at(F.col("context"), F.col("answer_start") - 1) & X.is_letter_at(a, F.lit(0))
    end = fits & X.is_letter_at(F.col("context"), e) & X.is_letter_at(a, F.length(a) - 1)
    r = examples.where(F.size("answers") > 0)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(~fits).alias("offset_mismatch"), F.count_if(start).alias("cut_start"), F.count_if(end).alias("cut_end"), F.round(F.try_divide(100.0 * (F.count_if(start) + F.count_if(end)), F.count(F.lit(1))), 2).alias("cut_any_pct"))


def split_profile(examples: DataFrame) -> DataFrame:
    """One row of corpus metrics: counts, mean lengths, how far questions overlap with their contexts, and where answers stand.

    answer_q1, _median and _q3 are the elements at int(n * p) of the first answers' places relative to their
    contexts, and answer_deciles their counts by tenths; answer_sentence_index counts the answers' sentences
    0 .. 6 (6 and later ones), in contexts of two sentences or more.
    """
    q = X.tokens(F.col("question"))
    inside = X.bound(F.struct(q.alias("q"), F.array_distinct(X.tokens(F.col("context"))).alias("c")), lambda x: F.size(F.filter(x["q"], lambda t: F.array_contains(x["c"], t))) / F.greatest(F.size(x["q"]), F.lit(1)))
    e = examples.withColumn("overlap", inside)
    n = lambda c: F.size(F.filter(F.split(c, X.SPACE), lambda t: t != ""))
    pct = lambda c: F.round(100 * F.avg(c), 4)
    a = F.get("answers", F.lit(0))
    mostly = X.bound(F.struct(q.alias("q"), X.tokens(a).alias("a")), lambda x: (F.size(x["a"]) > 0) & (2 * F.size(F.filter(x["a"], lambda t: F.array_contains(x["q"], t))) >= F.size(x["a"])))
    sentence = X.bound(X.sentence_spans(F.col("context")), lambda s: F.when(F.size(s) > 1, X.sentence_index(s, F.col("answer_start"))))
    has = ~F.col("is_impossible") & (F.size("answers") > 0)
    e = e.withColumns({"rel": F.when(has, F.col("answer_start") / F.greatest(F.length("context"), F.lit(1))), "mostly": F.when(has, mostly), "sentence": F.when(has, sentence)})
    tenth = lambda k: F.floor(10 * F.col("rel")) >= 9 if k == 9 else F.floor(10 * F.col("rel")) == k
    nth = lambda k: F.col("sentence") >= 6 if k == 6 else F.col("sentence") == k
    places = F.count_if(F.col("rel").isNotNull())
    counts = e.where("rel is not null").groupBy("rel").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    at = lambda p: F.round(F.min(F.when(F.col("c") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))), F.col("rel"))), 2)
    quarters = threshold.running_sums(counts, "rel", ["c"]).crossJoin(F.broadcast(total)).agg(at(0.25).alias("answer_q1"), at(0.5).alias("answer_median"), at(0.75).alias("answer_q3"))
    row = e.agg(
        F.count(F.lit(1)).alias("n_questions"), F.countDistinct("context").alias("n_contexts"), F.countDistinct("title").alias("n_titles"), F.count_if("is_impossible").alias("n_impossible"),
        F.round(F.avg(n(F.col("question"))), 4).alias("mean_question_words"), F.round(F.avg(n(F.col("context"))), 4).alias("mean_context_words"),
        pct(F.when(~F.col("is_impossible"), F.col("overlap"))).alias("overlap_answerable"), pct(F.when(F.col("is_impossible"), F.col("overlap"))).alias("overlap_impossible"),
        F.round(F.try_divide(100.0 * F.count_if("mostly"), places), 2).alias("answer_mostly_in_question_pct"),
        F.array(*[F.count_if(tenth(k)) for k in range(10)]).alias("answer_deciles"), F.array(*[F.count_if(nth(k)) for k in range(7)]).alias("answer_sentence_index"))
    return row.crossJoin(F.broadcast(quarters))  # one row each


def gold_variants(examples: DataFrame) -> DataFrame:
    """(n_golds, n): answerable questions by how many distinct answers they have."""
    return value_counts(examples.where(~F.col("is_impossible")), F.size(F.array_distinct("answers")), "n_golds")


def impossible_share(examples: DataFrame, by: Column, name: str) -> DataFrame:
    """(name, n, impossible_pct) per title, question word class or any other group."""
    return examples.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if("is_impossible") / F.count(F.lit(1)), 1).alias("impossible_pct"))


def edit_examples(pairs: DataFrame, order: DataFrame, most: int = 3, least: float = 0.6) -> DataFrame:
    """(edit, k, qid, question, sibling): of each edit type the first pairs of at least that similarity, by ord of (qid, ord)."""
    p = pairs.where(F.col("jaccard") >= least).withColumn("edit", X.edit_type(F.col("question"), F.col("sibling"))).join(order.select("qid", "ord"), "qid")
    k = F.row_number().over(Window.partitionBy("edit").orderBy("ord", "qid"))
    return p.withColumn("k", k).where(F.col("k") <= most).select("edit", "k", "qid", "question", "sibling")


def plausible_golds(examples: DataFrame) -> DataFrame:
    """(qid, is_gold, offset_ok): impossible questions with plausible answers, whether the first one, normalised, is
    an answer of an answerable question on the same context of the same title, and whether it stands at its offset."""
    norm = lambda a: F.concat_ws(" ", X.tokens(a))
    first, at = F.get("plausible", F.lit(0)), F.get("plausible_start", F.lit(0))
    mine = examples.where(F.col("is_impossible") & (F.size("plausible") > 0)).select("qid", "title", "context", norm(first).alias("p"), F.coalesce(F.substring("context", at + 1, F.length(first)) == first, F.lit(False)).alias("offset_ok"))
    gold = examples.where(~F.col("is_impossible")).select("title", "context", F.explode("answers").alias("a")).select("title", "context", norm(F.col("a")).alias("p")).where("p <> ''").distinct().withColumn("is_gold", F.lit(True))
    return mine.join(gold, ["title", "context", "p"], "left").select("qid", F.coalesce("is_gold", F.lit(False)).alias("is_gold"), "offset_ok")


def value_counts(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
