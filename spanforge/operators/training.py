"""Training logs: best epochs, curve diagnosis, loss stability, schedules and run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.runtime import saved

COLLAPSE = 0.5


def best_epoch(curves: DataFrame) -> DataFrame:
    """(run, best_epoch, best_f1): the largest val_f1, the earliest on ties."""
    best = F.max(F.struct("val_f1", (-F.col("epoch")).alias("e"), "val_em"))
    return curves.groupBy("run").agg(best.alias("b")).select("run", (-F.col("b.e")).alias("best_epoch"), F.col("b.val_f1").alias("best_f1"))


def curve_diagnosis(curves: DataFrame) -> DataFrame:
    """Per run: overfitting, train_loss_rising, still_improving, degenerate, best epoch and a verdict; one aggregation."""
    point = F.struct("epoch", "train_loss", "val_em", "val_f1")
    last = F.max(point)
    s = curves.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("val_f1", (-F.col("epoch")).alias("e"))).alias("b"), last.alias("last"), F.min("train_loss").alias("least_loss"),
        F.slice(F.sort_array(F.collect_list(F.struct("epoch", "val_f1")), asc=False), 2, 1).alias("before"), F.every(F.abs(F.col("val_em") - F.col("val_f1")) <= COLLAPSE).alias("degenerate"))
    best, many = -F.col("b.e"), F.col("n") >= 2
    declined = many & (best < F.col("last.epoch")) & (F.col("last.val_f1") < F.col("b.val_f1"))
    rising = many & (F.col("last.train_loss") > F.col("least_loss"))
    improving = many & (F.col("last.epoch") == best) & (F.col("last.val_f1") >= F.get("before", F.lit(0))["val_f1"])
    improving = F.coalesce(improving, F.lit(False))
    verdict = F.when(~many, "too short").when(declined & rising, "unstable").when(declined, "overfitting").when(improving, "still improving").otherwise("no clear trend")
    return s.select("run", best.alias("best_epoch"), (declined & ~rising).alias("overfitting"), rising.alias("train_loss_rising"), improving.alias("still_improving"), "degenerate", verdict.alias("verdict"))


def _numbered(steps: DataFrame, block: int) -> DataFrame:
    """(run, i, loss): i is a step's place in its run, from 0. Steps are counted by ranges of their numbers first, so no task sorts a run."""
    s = steps.select("run", "step", F.col("loss").cast("double").alias("loss")).withColumn("p", F.floor(F.col("step") / block))
    before = Window.partitionBy("run").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = s.groupBy("run", "p").agg(F.count(F.lit(1)).alias("n")).select("run", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("run", "p").orderBy("step", "loss"))
    return s.withColumn("k", inside).join(sizes, ["run", "p"]).select("run", (F.col("before") + F.col("k") - 1).alias("i"), "loss")


def stability(steps: DataFrame, window: int = 200, tolerance: float = 0.2, block: int = 1 << 16) -> DataFrame:
    """Per run: stable, max_rise and the first step (from 0) whose moving mean is over the least so far by more than tolerance.

    A run is cut into blocks of its steps. Each block also gets the last window - 1 steps of the one before, so its
    moving means are whole; the least means of the blocks are scanned first, a row per block, and then the
    steps inside each block go on from there. A run of any length is spread over many tasks.
    """
    if window <= 0:
        raise ValueError("the window must be positive")
    block = max(block, window)
    i = F.col("i")
    mine = F.floor(i / block)
    places = F.when(F.pmod(i, F.lit(block)) >= block - (window - 1), F.array(mine, mine + 1)).otherwise(F.array(mine))
    by = Window.partitionBy("run", "at").orderBy("i")
    s = _numbered(steps, block).select("run", "i", "loss", F.explode(places).alias("at"))
    smooth = s.withColumn("smooth", F.avg("loss").over(by.rowsBetween(1 - window, 0)))
    full = saved(smooth.where((F.col("at") == mine) & (i >= window - 1)).select("run", "at", "i", "smooth"), "smooth")
    earlier = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    least = full.groupBy("run", "at").agg(F.min("smooth").alias("own")).select("run", "at", F.min("own").over(earlier).alias("before"))
    running = F.least(F.min("smooth").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("before"))
    r = full.join(least, ["run", "at"]).withColumn("rise", F.round(F.col("smooth") - running, 9))
    found = r.groupBy("run").agg(F.max("rise").alias("m"), F.min(F.when(F.col("rise") > tolerance, i)).alias("f"))
    out = steps.select("run").distinct().join(found, "run", "left")
    return out.select("run", F.col("f").isNull().alias("stable"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("max_rise"), F.col("f").cast("bigint").alias("first_violation"))


def loss_by_label(steps: DataFrame) -> DataFrame:
    """Mean loss of CLS and span labels per run, and the share of CLS labels."""
    c = F.col("is_cls")
    return steps.groupBy("run").agg(F.round(F.avg(F.when(c, F.col("loss"))), 6).alias("cls_loss"), F.round(F.avg(F.when(~c, F.col("loss"))), 6).alias("span_loss"), F.round(F.avg(c.cast("double")), 6).alias("cls_share"))


def schedule(n: Column, batch: int, accumulate: int, epochs: int, warmup: float) -> Column:
    """struct<steps_per_epoch, total_steps, warmup_steps> for n examples."""
    if batch < 1 or accumulate < 1 or epochs < 1 or not 0 <= warmup <= 1:
        raise ValueError("arguments out of range")
    per = F.greatest(F.lit(1), F.floor(F.ceil(F.greatest(n, F.lit(1)) / batch) / accumulate)).cast("bigint")
    return F.struct(per.alias("steps_per_epoch"), (per * epochs).alias("total_steps"), F.floor(per * epochs * F.lit(float(warmup))).cast("bigint").alias("warmup_steps"))


def select_run(runs: DataFrame) -> DataFrame:
    """The run that reports use, from (run, dev_f1, curve_f1, stable, is_candidate, has_predictions).

    The best ordinary run by dev_f1, or by curve_f1 where that is missing; a stable candidate with
    predictions takes its place only if its own dev_f1 is strictly better.
    """
    has = runs.where("has_predictions")
    f1 = F.coalesce("dev_f1", "curve_f1")
    now = has.where(~F.col("is_candidate") & f1.isNotNull()).agg(F.max(F.struct(f1.alias("f"), "run")).alias("now"))
    cand = has.where("is_candidate and stable and dev_f1 is not null").agg(F.min(F.struct("run", F.col("dev_f1").alias("f"))).alias("c"))
    both = now.crossJoin(cand)  # one row each
    better = F.coalesce(F.col("c.f") > F.col("now.f"), F.lit(False))
    return both.select(F.when(better, F.col("c.run")).otherwise(F.col("now.run")).alias("run"), F.when(better, F.col("c.f")).otherwise(F.col("now.f")).alias("f1"), better.alias("is_stable_candidate"))


def collapsed(probe: DataFrame, factor: float = 2.0) -> DataFrame:
    """Per run: whether any later epoch's loss is over `factor` times the first one's."""
    first = F.min(F.struct("epoch", "loss"))
    s = probe.groupBy("run").agg(first.alias("first"), F.collect_list(F.struct("epoch", "loss")).alias("all"))  # one entry per epoch
    return s.select("run", F.exists("all", lambda x: (x["epoch"] > F.col("first.epoch")) & (x["loss"] > factor * F.col("first.loss"))).alias("collapsed"))
