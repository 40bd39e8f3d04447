"""No-answer thresholds: decisions at a threshold, candidates, the best one by an event sweep, and curves.

Input windows: (qid, window_ix, delta, score, em, f1) with the scores that the window's answer would
get; abstain: (qid, em0, f1_0) with the scores of no answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.operators import spans

EPS = 1e-6


def predictions_at(windows: DataFrame, tau: Column | float) -> DataFrame:
    """(qid, answer) at a threshold; '' where every window abstains."""
    best = F.max(F.when(F.col("score").isNotNull() & ~spans.abstains(F.col("delta"), tau), F.struct(F.col("score"), (-F.col("window_ix")).alias("w"), F.col("answer"))))
    return windows.groupBy("qid").agg(F.coalesce(best["answer"], F.lit("")).alias("answer"))


def candidate_taus(windows: DataFrame) -> DataFrame:
    """Distinct thresholds that can change a decision: 0, and each -delta a little up and down."""
    near = windows.where("delta is not null").select(F.explode(F.array(-F.col("delta") - EPS, -F.col("delta") + EPS)).alias("tau"))
    return near.unionByName(windows.sparkSession.sql("select 0.0D as tau")).distinct()


def running_sums(rows: DataFrame, order: str, values: list[str], buckets: int = 256) -> DataFrame:
    """Running sums of values up to and with each row, by `order` (distinct): over quantile buckets first, then inside them."""
    cuts = rows.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10_000).alias("cuts"))  # one row of `buckets` numbers
    r = rows.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(order)))).drop("cuts")
    sums = r.groupBy("bucket").agg(*[F.sum(v).alias(f"b_{v}") for v in values])
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    sums = sums.select("bucket", *[F.coalesce(F.sum(f"b_{v}").over(before), F.lit(0)).alias(f"b_{v}") for v in values])
    inside = Window.partitionBy("bucket").orderBy(order)
    r = r.join(sums, "bucket")
    return r.withColumns({v: F.col(f"b_{v}") + F.sum(v).over(inside) for v in values}).drop("bucket", *[f"b_{v}" for v in values])


def sweep(windows: DataFrame, abstain: DataFrame) -> DataFrame:
    """(tau, em, f1): summed scores of all questions at each candidate threshold.

    A question's answer only changes where the threshold passes -delta of one of its windows; each
    such cut is an event with the change in scores, and running sums over events and candidates give
    all totals at once, in place of deciding every question at every candidate.
    """
    w = windows.withColumn("cut", F.coalesce(-F.col("delta"), F.lit(float("inf"))))
    lasting = Window.partitionBy("qid").orderBy(F.desc("cut")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max(F.struct("score", (-F.col("window_ix")).alias("w"), "em", "f1")).over(lasting)
    steps = w.select("qid", "cut", top.alias("t")).distinct().select("qid", "cut", F.col("t.em").alias("em"), F.col("t.f1").alias("f1"))
    q = Window.partitionBy("qid").orderBy("cut")
    a = steps.join(abstain, "qid").withColumns({"next_em": F.lead("em").over(q), "next_f1": F.lead("f1").over(q), "k": F.row_number().over(q)})
    after = lambda c: F.coalesce(F.col(f"next_{c}"), F.col("em0" if c == "em" else "f1_0"))
    base = a.where("k = 1").agg(F.coalesce(F.sum("em"), F.lit(0.0)).alias("base_em"), F.coalesce(F.sum("f1"), F.lit(0.0)).alias("base_f1"))
    events = a.where(F.col("cut") < float("inf")).select(F.col("cut").alias("tau"), (after("em") - F.col("em")).alias("em"), (after("f1") - F.col("f1")).alias("f1"), F.lit(0).alias("asked"))
    asked = candidate_taus(windows).select("tau", F.lit(0.0).alias("em"), F.lit(0.0).alias("f1"), F.lit(1).alias("asked"))
    points = events.unionByName(asked).groupBy("tau").agg(F.sum("em").alias("em"), F.sum("f1").alias("f1"), F.max("asked").alias("asked"))
    total = running_sums(points, "tau", ["em", "f1"]).where("asked = 1").crossJoin(F.broadcast(base))  # one row
    return total.select("tau", (F.col("em") + F.col("base_em")).alias("em"), (F.col("f1") + F.col("base_f1")).alias("f1"))


def best_threshold(windows: DataFrame, abstain: DataFrame) -> DataFrame:
    """(tau, em, f1) in percent: the best F1 to six digits, then the threshold nearest to 0, then the smaller one."""
    n = abstain.agg(F.count(F.lit(1)).alias("n"))
    s = sweep(windows, abstain).crossJoin(F.broadcast(n)).select("tau", F.round(100 * F.col("em") / F.col("n"), 6).alias("em"), F.round(100 * F.col("f1") / F.col("n"), 6).alias("f1"))
    best = s.agg(F.max(F.struct("f1", (-F.abs("tau")).alias("a"), (-F.col("tau")).alias("t"), "em")).alias("b"))
    return best.select(F.round(-F.col("b.t"), 6).alias("tau"), F.col("b.em").alias("em"), F.col("b.f1").alias("f1"))


def no_answer_curve(windows: DataFrame, impossible: DataFrame, points: int = 41) -> DataFrame:
    """(k, tau, tp, fp, fn, precision, recall) of 'no answer' at thresholds between the order statistics of -delta at 2 and 98 %.

    impossible: (qid, is_impossible). A question abstains when its least cut (-delta) over windows, at most, is passed by all.
    """
    cuts = windows.groupBy("qid").agg(F.max(F.coalesce(-F.col("delta"), F.lit(float("inf")))).alias("cut"))
    d = windows.where("delta is not null").select((-F.col("delta")).alias("v"))
    n = d.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n == 0:
        return windows.sparkSession.createDataFrame([], "k int, tau double, tp bigint, fp bigint, fn bigint, precision double, recall double")
    lo, hi = int(0.02 * n), max(int(0.98 * n) - 1, 0)
    ranked = running_sums(d.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", ["c"])
    ends = ranked.agg(F.min(F.when(F.col("c") > lo, F.col("v"))).alias("lo"), F.min(F.when(F.col("c") > hi, F.col("v"))).alias("hi"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "lo", "hi").select("k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)).alias("tau"))
    taus = grid.agg(F.collect_list(F.struct("k", "tau")).alias("grid"))  # `points` rows
    rows = cuts.join(impossible, "qid").crossJoin(F.broadcast(taus)).select("cut", "is_impossible", F.inline("grid"))
    a = F.col("cut") <= F.col("tau")
    out = rows.groupBy("k", "tau").agg(F.count_if(a & F.col("is_impossible")).alias("tp"), F.count_if(a & ~F.col("is_impossible")).alias("fp"), F.count_if(~a & F.col("is_impossible")).alias("fn"))
    ratio = lambda x: F.round(F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)), 6)
    return out.select("k", "tau", "tp", "fp", "fn", ratio("fp").alias("precision"), ratio("fn").alias("recall"))


def calibrate(dev: DataFrame, dev_abstain: DataFrame, test: DataFrame) -> tuple[float, DataFrame]:
    """(tau chosen on dev, predictions of test at it); one number reaches the driver."""
    tau = best_threshold(dev, dev_abstain).first()["tau"]
    return tau, predictions_at(test, tau)


def stored_predictions(windows: DataFrame, taus: DataFrame) -> DataFrame:
    """(system, qid, prediction) of each system at its own stored threshold (system, tau); systems without one, or without windows, are left out."""
    w = windows.join(taus.where("tau is not null").select("system", "tau"), "system")
    best = F.max(F.when(F.col("score").isNotNull() & ~spans.abstains(F.col("delta"), F.col("tau")), F.struct(F.col("score"), (-F.col("window_ix")).alias("w"), F.col("answer"))))
    return w.groupBy("system", "qid").agg(F.coalesce(best["answer"], F.lit("")).alias("prediction"))


def stored_scores(windows: DataFrame, taus: DataFrame, refs: DataFrame) -> DataFrame:
    """Scores of stored thresholds: n, em and f1 in all, of answerable and of impossible questions, and the share of abstentions."""
    from spanforge.operators import scoring

    items = scoring.per_item(stored_predictions(windows, taus), refs, strict=False)
    none = F.col("is_impossible")
    mean = lambda c, keep=None: F.round(100 * F.avg(F.when(keep, F.col(c)) if keep is not None else F.col(c)), 4)
    return items.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), mean("em").alias("em"), mean("f1").alias("f1"), F.count_if(~none).alias("n_answerable"), mean("em", ~none).alias("em_answerable"), mean("f1", ~none).alias("f1_answerable"),
        F.count_if(none).alias("n_impossible"), mean("em", none).alias("em_impossible"), F.round(100 * F.avg((F.col("prediction") == "").cast("double")), 4).alias("abstain_rate"))


def self_check(windows: DataFrame, refs: DataFrame, direct: DataFrame, most: float = 0.01) -> DataFrame:
    """(system, em, f1, em_direct, f1_direct, agrees): scores rebuilt from windows at threshold 0 against those (system, em, f1) that a system got directly."""
    zero = windows.select("system").distinct().withColumn("tau", F.lit(0.0))
    got = stored_scores(windows, zero, refs).select("system", "em", "f1")
    both = got.join(direct.select("system", F.col("em").alias("em_direct"), F.col("f1").alias("f1_direct")), "system")
    return both.withColumn("agrees", (F.abs(F.col("em") - F.col("em_direct")) < most) & (F.abs(F.col("f1") - F.col("f1_direct")) < most))
