"""Scores of systems: exact match and token F1 per item, per corpus, per group and per dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import metrics as M
from spanforge.functions import text as X


def per_item(predictions: DataFrame, refs: DataFrame, strict: bool = True) -> DataFrame:
    """(system, qid, prediction, golds, em, f1, is_impossible).

    strict: a reference without a prediction is an error for that system; else it counts as ''.
    Predictions of unknown questions are ignored. The F1 of equal tokens is 1, so both scores come
    from one pass over the gold answers.
    """
    systems = predictions.select("system").distinct()
    all_ = refs.crossJoin(systems)
    out = all_.join(predictions, ["system", "qid"], "left")
    if strict:
        lost = out.where("prediction is null").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("q")).first()
        if lost["n"]:
            raise ValueError(f"{lost['n']} references have no prediction, such as {lost['q']}")
    p = F.coalesce("prediction", F.lit(""))
    return score_items(out.withColumn("prediction", p))


def score_items(rows: DataFrame) -> DataFrame:
    """Adds em, f1 and is_impossible to rows of (prediction, golds)."""
    g = F.transform(M.golds_or_empty(F.col("golds")), X.tokens)
    scored = X.bound(X.tokens(F.col("prediction")), lambda p: F.transform(g, lambda t: F.struct((p == t).cast("double").alias("em"), M.f1_of_tokens(p, t).alias("f1"))))
    return rows.withColumn("x", scored).withColumns({"em": F.array_max("x.em"), "f1": F.array_max("x.f1"), "is_impossible": F.size("golds") <= 0}).drop("x")


def percent(c: Column, digits: int = 6) -> Column:
    """Mean in percent; an empty group has 0, not NaN."""
    return F.round(F.coalesce(100 * F.avg(c), F.lit(0.0)), digits)


def corpus_scores(items: DataFrame, by: list[str] = ["system"]) -> DataFrame:  # noqa: B006
    answerable, impossible = ~F.col("is_impossible"), F.col("is_impossible")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), percent(F.col("em")).alias("em"), percent(F.col("f1")).alias("f1"),
        F.count_if(answerable).alias("n_answerable"), percent(F.when(answerable, F.col("em"))).alias("em_answerable"), percent(F.when(answerable, F.col("f1"))).alias("f1_answerable"),
        F.count_if(impossible).alias("n_impossible"), percent(F.when(impossible, F.col("em"))).alias("em_impossible"), percent(F.when(impossible, F.col("f1"))).alias("f1_impossible"))


def breakdown(items: DataFrame, tags: DataFrame, by: str, reliable: int = 30) -> DataFrame:
    """Scores per tag value; items without a tag are left out; small groups are marked unreliable."""
    rows = items.join(tags, "qid").where(F.col(by).isNotNull())
    n = F.count(F.lit(1))
    return rows.groupBy("system", by).agg(n.alias("n"), percent(F.col("em"), 4).alias("em"), percent(F.col("f1"), 4).alias("f1"), (n < reliable).alias("unreliable"))


def by_dimension(items: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(system, dimension, value, n, em, f1) over several dimensions in one aggregation; null values are left out."""
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("value")) for k, v in dimensions.items()], F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    long = items.select("system", "em", "f1", F.explode(each).alias("x")).select("system", "x.dimension", "x.value", "em", "f1").where("value is not null")
    return long.groupBy("system", "dimension", "value").agg(F.count(F.lit(1)).alias("n"), percent(F.col("em"), 4).alias("em"), percent(F.col("f1"), 4).alias("f1"))


def slice_scores(items: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """(system, slice, n, em, f1): an empty slice has n 0 and null scores."""
    aggs = []
    for name, keep in slices.items():
        aggs.append(F.struct(F.lit(name).alias("slice"), F.count_if(keep).alias("n"), F.round(100 * F.avg(F.when(keep, F.col("em"))), 6).alias("em"), F.round(100 * F.avg(F.when(keep, F.col("f1"))), 6).alias("f1")))
    return items.groupBy("system").agg(F.array(*aggs).alias("x")).select("system", F.inline("x"))


def threshold_scores(items: DataFrame, by: list[str] = ["system"]) -> DataFrame:  # noqa: B006
    """Scores with the abstention rate; here only '' is an abstention."""
    raw = M.abstained(F.col("prediction"), "raw")
    return items.groupBy(*by).agg(percent(F.col("em")).alias("em"), percent(F.col("f1")).alias("f1"), percent(F.when(~F.col("is_impossible"), F.col("em"))).alias("em_answerable"), percent(F.when(F.col("is_impossible"), raw.cast("double"))).alias("em_impossible"), percent(raw.cast("double")).alias("abstain_pct"))


def always_abstain(examples: DataFrame) -> DataFrame:
    return examples.select(F.lit("abstain").alias("system"), "qid", F.lit("").alias("prediction"))


def evaluate(examples: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """Gate, scores, breakdowns by context length and question type (answerable questions alone), first samples."""
    from spanforge.operators import dataset

    dataset.assert_gradeable(examples)
    items = per_item(predictions, dataset.references(examples))
    t = tags(examples)
    return {
        "overall": corpus_scores(items), "by_length": breakdown(items, t, "length_bucket"),
        "by_question_type": breakdown(items.where("not is_impossible"), t, "question_type"),
        "samples": items.join(examples.select("qid", "ord"), "qid").orderBy("system", "ord").limit(10),
    }


def checkpoint_scores(examples: DataFrame, predictions: DataFrame, n: int | None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(scores, question ids used) on a seeded subset."""
    from spanforge.operators import dataset

    used = dataset.seeded_sample(examples, "qid", n, seed)
    items = per_item(predictions, dataset.references(used), strict=False)
    return corpus_scores(items), used.select("qid")


def _legacy(prediction: Column, golds: Column) -> Column:
    """struct<em, f1>: the best over golds by the older normaliser; without a common token F1 is 0, also of two empty sides."""
    words = lambda t: F.filter(F.split(X.legacy_normalize(F.coalesce(t, F.lit(""))), " "), lambda w: w != "")

    def one(p: Column, g: Column) -> Column:
        return X.bound(F.struct(p.alias("p"), words(g).alias("g")), lambda x: F.struct((x["p"] == x["g"]).cast("double").alias("em"), F.when(F.size(x["p"]) == 0, F.lit(0.0)).otherwise(M.f1_of_tokens(x["p"], x["g"])).alias("f1")))

    each = X.bound(words(prediction), lambda p: F.transform(golds, lambda g: one(p, g)))
    return X.bound(each, lambda e: F.struct(F.array_max(F.transform(e, lambda m: m["em"])).alias("em"), F.array_max(F.transform(e, lambda m: m["f1"])).alias("f1")))


def legacy_scores(rows: DataFrame) -> DataFrame:
    """(system, n, em, f1) of rows with system, prediction and golds, by the older evaluation: without golds a row scores 0, and counts."""
    s = rows.withColumn("x", F.when(F.size("golds") > 0, _legacy(F.col("prediction"), F.col("golds"))))
    return s.groupBy("system").agg(F.count(F.lit(1)).alias("n"), percent(F.coalesce("x.em", F.lit(0.0))).alias("em"), percent(F.coalesce("x.f1", F.lit(0.0))).alias("f1"))


def legacy_span_metrics(rows: DataFrame, word_level: bool = False) -> DataFrame:
    """(system, exact_match, f1, total) of rows with system, prediction and golds, null where a prediction has no reference: such rows don't count.

    Without golds a question is unanswerable, and only a blank prediction is right. word_level takes the _ out of segmented words first.
    """
    text = X.desegment(F.coalesce("prediction", F.lit(""))) if word_level else F.coalesce("prediction", F.lit(""))
    blank = (X.strip(text) == "").cast("double")
    s = rows.where(F.col("golds").isNotNull()).withColumn("x", F.when(F.size("golds") > 0, _legacy(text, F.col("golds"))).otherwise(F.struct(blank.alias("em"), blank.alias("f1"))))
    counted = s.groupBy("system").agg(percent(F.col("x.em"), 4).alias("exact_match"), percent(F.col("x.f1"), 4).alias("f1"), F.count(F.lit(1)).alias("total"))
    systems = rows.select("system").distinct()
    return systems.join(counted, "system", "left").na.fill(0)


def legacy_lengths(rows: DataFrame) -> DataFrame:
    """(system, pred_avg_length, gt_avg_length): mean words of predictions and first golds, of rows with golds; 0 without any."""
    n = lambda c: F.size(F.filter(F.split(X.legacy_normalize(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))
    some = F.size("golds") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(some, n(c))), F.lit(0.0))
    return rows.groupBy("system").agg(mean(F.col("prediction")).alias("pred_avg_length"), mean(F.get("golds", F.lit(0))).alias("gt_avg_length"))


def source_scores(items: DataFrame, stress: DataFrame) -> DataFrame:
    """Scores of stress slices from the predictions of their source questions."""
    rows = stress.where("role = 'slice'").select("subset", F.col("source_qid").alias("qid")).join(items, "qid")
    return rows.groupBy("system", "subset").agg(F.count(F.lit(1)).alias("n"), percent(F.col("em"), 4).alias("em"), percent(F.col("f1"), 4).alias("f1"))


def tags(examples: DataFrame) -> DataFrame:
    """(qid, question_type, length_bucket, context_words); impossible questions have no question type."""
    n = F.size(F.filter(F.split("context", X.SPACE), lambda t: t != ""))
    return examples.select("qid", F.when(~F.col("is_impossible"), X.question_type(F.col("question"), F.col("context"))).alias("question_type"), X.length_bucket(n).alias("length_bucket"), n.cast("long").alias("context_words"))
