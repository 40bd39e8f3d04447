"""Exact two-sided McNemar tests as columns, and bootstrap intervals whose resamples draw exactly n with replacement."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import ready, saved

#: ln(n!) minus Stirling's formula for n up to 15; a series beyond.
_SMALL = [0.0] + [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) for n in range(1, 16)]
#: Coefficients of that series in 1/n, 1/n^3 and so on.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Distinct cells in a bucket of the tree on average.
BUCKET = 1 << 15


def _stirling_error(n: Column) -> Column:
    series, power = F.lit(0.0), 1 / n
    for c in _SERIES:
        series, power = series + c * power, power / (n * n)
    return F.when(n <= 15, F.get(F.array(*map(F.lit, _SMALL)), n.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, by a series where the two are close."""
    v = (x - mean) / (x + mean)
    terms = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda j: 2 * x * F.pow(v, 2 * j + 1) / (2 * j + 1))
    near = F.aggregate(terms, (x - mean) * v, lambda a, t: a + t)
    return F.when(F.abs(x - mean) < 0.1 * (x + mean), near).otherwise(x * F.log(x / mean) + mean - x)


def log_mcnemar(b: Column, c: Column) -> Column:
    """Natural logarithm of the exact two-sided p-value of two discordant counts; 0 without any, and at most.

    The tail of a binomial with probability 1/2 is its last term, by a saddle-point form without
    cancellation, times a sum of ratios that fall off: after some multiple of sqrt(n) of them nothing is added.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    m = n - k
    last = F.when(k == 0, -n * math.log(2)).otherwise(
        _stirling_error(n) - _stirling_error(k) - _stirling_error(m) - _deviance(k, n / 2) - _deviance(m, n / 2) + 0.5 * F.log(n / (2 * math.pi * k * m)))
    terms = F.least(k, F.ceil(F.sqrt(24 * n)) + 64).cast("int")
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i + 1) / (m + i)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    total = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, add)["sum"]).otherwise(F.lit(1.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), F.lit(math.log(2)) + last + F.log(total)))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """The exact two-sided p-value, 1 without discordant pairs; below the smallest double it is 0, and log_mcnemar has it."""
    return F.exp(log_mcnemar(b, c))


def paired_tests(tables: DataFrame) -> DataFrame:
    """Adds p_value and log10_p to rows with n_only_a and n_only_b, one for each pair of systems and slice."""
    log = log_mcnemar(F.col("n_only_a"), F.col("n_only_b"))
    return tables.withColumns({"p_value": F.exp(log), "log10_p": log / math.log(10)})


def _halves(weights: np.ndarray, drawn: np.ndarray, wanted: int, seed: list[int]) -> np.ndarray:
    """What bucket `wanted` gets of each resample's draws: they are split binomially on the way down a binary tree of buckets.

    A node's generator is seeded by its own place, so that all tasks draw the same numbers at the nodes they share.
    """
    low, high = 0, len(weights)
    total = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
    while high - low > 1:
        middle = (low + high) // 2
        share = (total[middle] - total[low]) / max(1, total[high] - total[low])
        left = np.random.default_rng([*seed, low, high]).binomial(drawn, min(1.0, share))
        low, high, drawn = (low, middle, left) if wanted < middle else (middle, high, drawn - left)
    return drawn


def resampled(cells: DataFrame, resamples: int = 2000, seed: int = 42, draws: int | None = None) -> DataFrame:
    """(b, n, s, c): for each resample how many cells were drawn, with replacement, and the sums of their s and c.

    As many are drawn as there are cells, or `draws`. Equal cells (s, c) are one with a weight, since which of them is drawn makes no
    difference. Buckets of cells get their draws down a tree, the cells of a bucket theirs one after the
    other; each step is a binomial draw for all resamples at once. So every resample has exactly its
    number of draws, and nothing but one row per bucket and resample is shuffled.
    """
    kinds = saved(cells.select(F.col("s").cast("double").alias("s"), F.col("c").cast("double").alias("c")).where("s is not null and c is not null").groupBy("s", "c").agg(F.count(F.lit(1)).alias("w")), "cells")
    n_kinds = kinds.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(1, n_kinds) / BUCKET)))
    placed = kinds.withColumn("k", F.pmod(F.xxhash64("s", "c"), F.lit(buckets)).cast("int"))
    sizes = {r.k: int(r.w) for r in placed.groupBy("k").agg(F.sum("w").alias("w")).collect()}  # one number per bucket
    weights = np.array([sizes.get(k, 0) for k in range(buckets)], np.int64)
    n = int(weights.sum()) if draws is None else draws
    ready(cells.sparkSession)

    def drawn(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        s, c, w = (table.column(x).to_numpy() for x in ("s", "c", "w"))
        order = np.lexsort((c, s))
        left, rest = _halves(weights, np.full(resamples, n, np.int64), k, [seed, 1]), int(w.sum())
        rng, got = np.random.default_rng([seed, 2, k]), [np.zeros(resamples) for _ in range(2)]
        count = left.copy()
        for i in order:
            mine = rng.binomial(left, min(1.0, w[i] / rest))
            got[0] += mine * s[i]
            got[1] += mine * c[i]
            left, rest = left - mine, rest - int(w[i])
            if not left.any():
                break
        return pa.table({"b": pa.array(np.arange(resamples, dtype=np.int32)), "n": pa.array(count), "s": pa.array(got[0]), "c": pa.array(got[1])})

    return placed.groupBy("k").applyInArrow(drawn, "b int, n long, s double, c double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))


def bootstrap_ci(cells: DataFrame, resamples: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(mean, low, high) of sum(s) / sum(c) over cells (s, c): items, or clusters for the clustered interval.

    The ends are the elements int(2.5 %) and int(97.5 %) - 1 of the sorted resamples. Without cells all three are null.
    """
    m = resampled(cells, resamples, seed).where("c <> 0").select((F.col("s") / F.col("c")).alias("m"))
    low, high = int((1 - level) / 2 * resamples), int((1 + level) / 2 * resamples) - 1
    ends = m.agg(F.sort_array(F.collect_list("m")).alias("m"))  # as long as there are resamples
    mean = cells.agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))
    return mean.crossJoin(ends).select("mean", F.get("m", F.least(F.lit(low), F.size("m") - 1)).alias("low"), F.get("m", F.least(F.lit(high), F.size("m") - 1)).alias("high"))  # one row each
