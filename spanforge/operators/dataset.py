"""Dataset hygiene: gates, splits, samples, de-duplication and leakage checks.

Random order is the order of md5(seed:key): the same on every partitioning and engine.
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
from spanforge.runtime import ready


def is_gradeable() -> Column:
    """Gold answers, or declared impossible; an empty gold list alone says nothing."""
    return (F.size("answers") > 0) | F.col("is_impossible")


def assert_gradeable(examples: DataFrame) -> None:
    bad = examples.where(~is_gradeable())
    row = bad.agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("least")).first()
    if row["n"]:
        first = [r[0] for r in bad.select("qid").orderBy("qid").limit(5).collect()]
        raise ValueError(f"{row['n']} questions can't be graded: {', '.join(map(str, first))}")


def assert_consistent(examples: DataFrame) -> DataFrame:
    """The examples, with an error on any impossible question that has answers."""
    ok = F.assert_true(~(F.col("is_impossible") & (F.size("answers") > 0)), F.lit("an impossible question has answers"))
    return examples.where(ok.isNull())


def references(examples: DataFrame) -> DataFrame:
    return examples.select("qid", F.col("answers").alias("golds"))


def draw(key: Column, seed: object = 42) -> Column:
    """A key's place in a seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_by_key(rows: DataFrame, key: str, fraction: float = 0.2, seed: object = 42, names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """Splits by groups: int(groups * fraction) of them, the first in the seeded order, are the second part.

    The cut is a quantile of the distinct keys' order, found by an exact rank over bucket counts, so no
    task sorts all keys.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction is not between 0 and 1")
    keys = rows.select(draw(F.col(key), seed).alias("draw")).distinct()
    ranked = first_by_draw(keys, F.floor(F.lit(float(fraction)) * F.col("n")))
    chosen = ranked.select("draw", F.lit(True).alias("second"))
    out = rows.withColumn("draw", draw(F.col(key), seed)).join(chosen, "draw", "left")
    return out.withColumn("split", F.when(F.col("second"), names[1]).otherwise(names[0])).drop("draw", "second")


def first_by_draw(keys: DataFrame, most: Column, place: str | None = None) -> DataFrame:
    """Rows of (draw, ...) that are among the first `most` by draw; `most` may name the total n. place: a column for the rank, from 1.

    Counts per leading four hex digits (65536 at most) place each bucket; ranks are taken inside
    buckets alone.
    """
    rows = keys.withColumn("bucket", F.substring("draw", 1, 4))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("bucket", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"), F.sum("c").over(everything).alias("n"))
    sizes = sizes.withColumn("most", most).where("before < most").select("bucket", "before", "most")
    inside = Window.partitionBy("bucket").orderBy("draw")
    ranked = rows.join(sizes, "bucket").withColumn("rank", F.col("before") + F.row_number().over(inside))
    ranked = ranked.where("rank <= most").drop("bucket", "before", "most")
    return ranked.withColumnRenamed("rank", place) if place else ranked.drop("rank")


def seeded_sample(rows: DataFrame, key: str, n: int | None, seed: object = 42) -> DataFrame:
    """n rows without replacement, the first in the seeded order; all if n is None or not smaller."""
    if n is None:
        return rows
    return first_by_draw(rows.withColumn("draw", draw(F.col(key), seed)), F.lit(n)).drop("draw")


def three_way_split(rows: DataFrame, key: str, fractions: tuple[float, float] = (0.8, 0.1), seed: object = 42) -> DataFrame:
    """train, validation and test by groups; validation and test are cut from what is left."""
    first = split_by_key(rows, key, 1 - fractions[0], seed, ("train", "rest"))
    rest = first.where("split = 'rest'").drop("split")
    return first.where("split = 'train'").unionByName(split_by_key(rest, key, 1 - fractions[1] / (1 - fractions[0]), f"{seed}-2", ("validation", "test")))


def rotating_split(rows: DataFrame, key: str, place: Column, names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Splits by groups in turn: a group goes where the place of its first row (from 0, in the whole order) falls, modulo the splits."""
    first = rows.groupBy(F.xxhash64(key).alias("h"), F.col(key).alias("g")).agg(F.min(place).alias("first"))
    out = rows.withColumn("h", F.xxhash64(key)).alias("r").join(first.alias("f"), (F.col("r.h") == F.col("f.h")) & F.col(f"r.{key}").eqNullSafe(F.col("f.g")))
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.col("first"), F.lit(len(names))).cast("int")).alias("split"))


def shared_contexts(rows: DataFrame) -> DataFrame:
    """Distinct contexts that stand in more than one split, as their md5 and the splits."""
    seen = rows.groupBy(F.md5("context").alias("context_md5")).agg(F.sort_array(F.collect_set("split")).alias("s"))
    return seen.where(F.size("s") > 1).select("context_md5", F.concat_ws(",", "s").alias("splits"))


def assert_no_leakage(rows: DataFrame) -> None:
    shared = shared_contexts(rows)
    n = shared.count()
    if n:
        raise ValueError(f"{n} contexts are in several splits, such as {shared.first()['context_md5']}")


def without_contexts_of(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose context is nowhere in the other table."""
    o = other.select(F.xxhash64("context").alias("oh"), F.col("context").alias("oc")).distinct()
    return rows.join(o, (F.xxhash64(rows["context"]) == o["oh"]) & (rows["context"] == o["oc"]), "left_anti")


def cross_split_overlap(rows: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """(kind, key, n_rows, splits): keys of each kind that occur in two splits or more; one scan for all kinds."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys])
    long = rows.select("split", F.explode(each).alias("x")).select("split", "x.kind", "x.key").where("key is not null")
    seen = long.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_set("split")).alias("s"))
    return seen.where(F.size("s") > 1).select("kind", "key", "n_rows", F.concat_ws(",", "s").alias("splits"))


def leakage_severity(overlaps: DataFrame) -> DataFrame:
    """(n_overlaps, severity): clean, low below 5, medium below 50, else high."""
    n = F.col("n_overlaps")
    return overlaps.agg(F.count(F.lit(1)).alias("n_overlaps")).withColumn("severity", F.when(n == 0, "clean").when(n < 5, "low").when(n < 50, "medium").otherwise("high"))


def split_stats(examples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Questions, distinct contexts and titles, impossible, with gold, gradeable, and the impossible share in percent."""
    n = F.count(F.lit(1))
    return examples.groupBy(*(by or [])).agg(
        n.alias("n_questions"), F.countDistinct("context").alias("n_contexts"), F.countDistinct("title").alias("n_titles"),
        F.count_if("is_impossible").alias("n_impossible"), F.count_if(F.size("answers") > 0).alias("n_with_gold"), F.count_if(is_gradeable()).alias("n_gradeable"),
        F.round(F.try_divide(100.0 * F.count_if("is_impossible"), n), 2).alias("impossible_pct"))


def distribution_shift(rows: DataFrame, flag: Column) -> DataFrame:
    """Share of flagged rows per split."""
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged"), F.round(F.avg(flag.cast("double")), 6).alias("ratio"))


def _band_keys(per: int, bands: int):
    """The function of a batch of (id, splits, sh) to (id, splits, n, keys): sizes, and a key a band from the least values of sh under `per` hashes."""
    add, factor = np.random.default_rng(42).integers(0, 1 << 64, (2, bands, per), dtype=np.uint64)
    factor |= np.uint64(1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sh = x.column("sh")
            flat, size = sh.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sh.value_lengths().to_numpy(zero_copy_only=False)
            if not len(size):
                continue
            first = np.cumsum(size) - size
            key = np.zeros((len(size), bands), np.uint64)
            for b in range(bands):
                for k in range(per):
                    key[:, b] = (key[:, b] ^ np.minimum.reduceat((flat + add[b, k]) * factor[b, k], first)) * factor[b, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("splits"), pa.array(size, pa.int32()), lists], ["id", "splits", "n", "keys"])

    return keys


def _shared_bands(p: float, bands: int, missed: float = 1e-8) -> int:
    """The most bands, one at least, of which a pair that shares each with probability p has fewer with a probability of `missed` at most."""
    fewer, n = (1 - p) ** bands, 1
    while n < bands and (fewer := fewer + math.comb(bands, n) * p**n * (1 - p) ** (bands - n)) <= missed:
        n += 1
    return n


def near_duplicate_contexts(rows: DataFrame, threshold: float = 0.8, words: int = 5, hashes: int = 50, bands: int = 25) -> DataFrame:
    """(context_a, context_b, jaccard) md5 pairs of near-equal distinct contexts in different splits.

    MinHash with one set of salts for all contexts finds candidates by bands (two hashes each at
    the defaults): pairs that share three bands of 25, which a pair at the threshold fails to once
    in 10^8 and most unlike pairs fail to; the exact Jaccard similarity of
    their word shingles decides. Equal contexts are one context here.
    """
    toks = lambda c: F.filter(F.split(F.lower(F.trim(c)), X.SPACE), lambda t: t != "")
    shingle = X.bound(toks(F.col("context")), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(words)])))))
    seen = rows.groupBy("context").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    seen = seen.select(F.md5("context").alias("id"), "splits", shingle.alias("sh"))
    ready(rows.sparkSession)
    keyed = seen.where("id is not null").mapInArrow(_band_keys(hashes // bands, bands), "id string, splits array<string>, n int, keys array<long>")
    keyed = keyed.select("id", "splits", "n", F.posexplode("keys").alias("band", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    least = threshold - 1e-6  # similarities are rounded; one of two sets can't be smaller than this share of the other
    pairs = pairs.where((F.col("a.n") >= least * F.col("b.n")) & (F.col("b.n") >= least * F.col("a.n")))
    pairs = pairs.where(F.size(F.array_union("a.splits", "b.splits")) > 1).groupBy(F.col("a.id").alias("context_a"), F.col("b.id").alias("context_b")).agg(F.count(F.lit(1)).alias("bands"))
    pairs = pairs.where(F.col("bands") >= _shared_bands(threshold ** (hashes // bands), bands)).drop("bands")
    s = seen.select("id", "sh")
    out = pairs.join(s.withColumnsRenamed({"id": "context_a", "sh": "sa"}), "context_a").join(s.withColumnsRenamed({"id": "context_b", "sh": "sb"}), "context_b")
    return out.select("context_a", "context_b", F.round(X.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard")).where(F.col("jaccard") >= threshold)
