"""Error taxonomy, abstention, paired comparisons and tests between systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import metrics as M
from spanforge.functions import text as X


def classified(items: DataFrame) -> DataFrame:
    return items.withColumn("error", M.error_class(F.col("prediction"), F.col("golds")))


def error_taxonomy(items: DataFrame) -> DataFrame:
    """(system, error, n, pct): all six classes for every system; pct is of the system's errors, 0 without any."""
    c = classified(items)
    counts = c.groupBy("system").agg(F.count("error").alias("n_errors"), *[F.count_if(F.col("error") == e).alias(e) for e in M.ERROR_CLASSES])
    rows = F.array(*[F.struct(F.lit(e).alias("error"), F.col(e).alias("n")) for e in M.ERROR_CLASSES])
    long = counts.select("system", "n_errors", F.inline(rows))
    return long.select("system", "error", "n", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("n_errors")), F.lit(0.0)), 2).alias("pct"))


def abstention(items: DataFrame, rule: str = "tokens") -> DataFrame:
    """Abstaining as a classifier of impossible questions."""
    a, i = M.abstained(F.col("prediction"), rule), F.size("golds") <= 0
    c = items.groupBy("system").agg(F.count_if(a & i).alias("tp"), F.count_if(a & ~i).alias("fp"), F.count_if(~a & i).alias("fn"), F.count_if(~a & ~i).alias("tn"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    c = c.withColumns({"p": p, "r": r})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return c.select("system", "tp", "fp", "fn", "tn", F.round(100.0 * (F.col("tp") + F.col("fp")) / n, 2).alias("abstain_rate"), F.round(100 * F.col("p"), 2).alias("precision"), F.round(100 * F.col("r"), 2).alias("recall"), F.round(100 * f1, 2).alias("f1"))


def paired(items_a: DataFrame, items_b: DataFrame) -> DataFrame:
    """Common questions of two systems: (qid, em_a, em_b)."""
    return items_a.select("qid", F.col("em").alias("em_a")).join(items_b.select("qid", F.col("em").alias("em_b")), "qid")


def paired_table(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    a, b = F.col("em_a") >= 0.5, F.col("em_b") >= 0.5
    return pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_only_a"), F.count_if(~a & b).alias("n_only_b"), F.count_if(~a & ~b).alias("n_neither"), F.round(100 * (F.avg("em_a") - F.avg("em_b")), 6).alias("diff"))


def cluster_cells(pairs: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cell, s, c): summed EM differences and sizes of clusters; what the clustered bootstrap resamples."""
    return pairs.groupBy(F.col(cluster).alias("cell")).agg(F.sum(F.col("em_a") - F.col("em_b")).alias("s"), F.count(F.lit(1)).alias("c"))


def disagreements(items: DataFrame, a: str, b: str, fold: bool = True) -> DataFrame:
    """Questions that exactly one of two systems has right: winner and the loser's error class."""
    c = classified(items)
    side = lambda s, n: c.where(F.col("system") == s).select("qid", F.col("em").alias(f"em_{n}"), F.col("error").alias(f"error_{n}"), F.col("prediction").alias(f"prediction_{n}"))
    rows = side(a, "a").join(side(b, "b"), "qid").where("em_a <> em_b")
    kind = F.coalesce("error_a", "error_b")
    return rows.select("qid", F.when(F.col("em_a") > F.col("em_b"), a).otherwise(b).alias("winner"), (F.when(kind.startswith("boundary"), "boundary").otherwise(kind) if fold else kind).alias("kind"), F.col("prediction_a"), F.col("prediction_b"))


def disagreement_page(items: DataFrame, a: str, b: str, kind: str = "all", most: int = 24) -> DataFrame:
    """The first disagreements by question with an error of that kind on either side, boundary kinds as one, and the total of them all."""
    rows = disagreements(items, a, b)
    rows = rows if kind == "all" else rows.where(F.col("kind") == kind)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("qid").limit(most).crossJoin(total)  # one row


def both_answered(items: DataFrame) -> DataFrame:
    """(system_a, system_b, n, em_a, em_b) over answerable questions that both systems answer, for all pairs of systems."""
    r = items.where(~F.col("is_impossible") & ~M.abstained(F.col("prediction"), "raw")).select("system", "qid", "em")
    # one row per question with all its systems; pairs of systems are formed inside it
    per = r.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("system", "em"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["system"] > p["system"]), lambda q: F.struct(p["system"].alias("system_a"), q["system"].alias("system_b"), p["em"].alias("a"), q["em"].alias("b")))))
    return per.select(F.inline(pairs)).groupBy("system_a", "system_b").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("a"), 6).alias("em_a"), F.round(100 * F.avg("b"), 6).alias("em_b"))


def plausible_trap(items: DataFrame, plausible: DataFrame) -> DataFrame:
    """Answered impossible questions, and how many of their answers equal a plausible one."""
    rows = items.where((F.size("golds") <= 0) & ~M.abstained(F.col("prediction"), "strip")).join(plausible, "qid")
    hit = F.exists("plausible", lambda t: M.exact_match(F.col("prediction"), t) == 1)
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("n_answered"), F.count_if(hit).alias("n_trapped"))


def _legacy_classified(items: DataFrame) -> DataFrame:
    """Wrong predictions with their class x; right are equal normalised texts, and no answer to an impossible question."""
    gold = F.coalesce(F.get("golds", F.lit(0)), F.lit(""))
    prediction = F.coalesce("prediction", F.lit(""))
    right = (X.spaced_normalize(gold) == X.spaced_normalize(prediction)) | (F.col("is_impossible") & (prediction == ""))
    return items.where(~right).withColumn("x", M.legacy_error_class(F.col("question"), F.col("context"), gold, prediction, F.col("is_impossible")))


def legacy_errors(items: DataFrame) -> DataFrame:
    """(system, category, subtype, n, ratio) of wrong predictions, from rows with question and context."""
    rows = _legacy_classified(items)
    n = rows.groupBy("system", "x.category", "x.subtype").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("system").agg(F.count(F.lit(1)).alias("t"))
    return n.join(total, "system").select("system", "category", "subtype", "n", F.round(F.col("n") / F.col("t"), 6).alias("ratio"))


def legacy_case_studies(items: DataFrame, most: int = 10) -> DataFrame:
    """(system, category, k, qid, subtype, confidence, ratio): of each of the five classes the most / 5 errors with the most confidence, the first by question on ties, and the share of the class."""
    rows = _legacy_classified(items).select("system", "x.category", "x.subtype", "qid", "confidence")
    k = F.row_number().over(Window.partitionBy("system", "category").orderBy(F.desc("confidence"), "qid"))
    n = rows.groupBy("system", "category").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("system").agg(F.count(F.lit(1)).alias("t"))
    best = rows.withColumn("k", k).where(F.col("k") <= most // 5)
    return best.join(n, ["system", "category"]).join(total, "system").select("system", "category", "k", "qid", "subtype", "confidence", F.round(F.col("n") / F.col("t"), 4).alias("ratio"))


def error_sample(items: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Up to n errors of each system, the first in a seeded order."""
    from spanforge.operators.dataset import draw

    w = Window.partitionBy("system").orderBy(draw(F.concat("system", F.lit(":"), "qid"), seed))
    return classified(items).where("error is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def kappa(sheet: DataFrame, a: str = "nguoi_1", b: str = "nguoi_2") -> DataFrame:
    """(n, agreement_pct, kappa) of two reviewers' ok / loai; rows without both verdicts don't count."""
    r = sheet.where(F.col(a).isin("ok", "loai") & F.col(b).isin("ok", "loai"))
    ok = lambda c: F.avg((F.col(c) == "ok").cast("double"))
    s = r.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), ok(a).alias("pa"), ok(b).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    value = F.when(F.col("n") == 0, F.lit(None)).when(pe >= 1, F.lit(1.0)).otherwise((F.col("po") - pe) / (1 - pe))
    return s.select("n", F.round(100 * F.col("po"), 2).alias("agreement_pct"), F.round(value, 3).alias("kappa"))


def rejected(items: DataFrame, sheet: DataFrame, key: Column | None = None) -> DataFrame:
    """Items without those that a reviewer rejects, nor the originals that go with them."""
    no = sheet.where((F.col("nguoi_1") == "loai") | (F.col("nguoi_2") == "loai")).select(F.col("qid").alias("rejected"))
    base = F.regexp_replace(items["qid"].cast("string"), "-orig$", "")
    return items.join(no, base == F.col("rejected").cast("string"), "left_anti")
