"""Report tables: pivots, deltas against a baseline and formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as X


def pivot(scores: DataFrame, row: str, order: list[str], systems: list[str], value: str = "f1", n: str = "n", reliable: int = 30) -> DataFrame:
    """One row per bucket, in a fixed order, one column per system; a small group's value has a dagger, a missing one a blank."""
    shown = F.concat(F.format_number(value, 2), F.when(F.col(n) < reliable, "†").otherwise(""))
    p = scores.where(F.col(row).isin(order)).groupBy(row).pivot("system", systems).agg(F.first(shown))
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(row))
    return p.select(place.cast("int").alias("place"), row, *[F.coalesce(F.col(s), F.lit("")).alias(s) for s in systems])


def delta_to(scores: DataFrame, baseline: str, values: list[str]) -> DataFrame:
    """Scores with their difference to a baseline system; the baseline's row is one."""
    base = scores.where(F.col("system") == baseline).select(*[F.col(v).alias(f"b_{v}") for v in values])
    return scores.crossJoin(F.broadcast(base)).select("system", *values, *[F.round(F.col(v) - F.col(f"b_{v}"), 6).alias(f"d_{v}") for v in values])


def coalesced(tuned: DataFrame, plain: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Tuned values where there are any, else the plain ones."""
    t = tuned.select(*keys, *[F.col(v).alias(f"t_{v}") for v in values])
    return plain.join(t, keys, "full_outer").select(*keys, *[F.coalesce(f"t_{v}", v).alias(v) for v in values])


def floored(x: Column, digits: int = 1) -> Column:
    return F.floor(10**digits * x) / 10**digits


def formatted(scores: DataFrame, counts: list[str], values: list[str]) -> DataFrame:
    keep = [c for c in scores.columns if c not in counts and c not in values]
    return scores.select(*keep, *[X.locale_number(F.col(c), 0).alias(c) for c in counts], *[X.locale_number(F.col(v), 2).alias(v) for v in values], *[X.heat(F.col(v)).cast("int").alias(f"heat_{v}") for v in values])


def first_per_kind(rows: DataFrame, kinds: list[tuple[str, Column]], order: str, n: int) -> DataFrame:
    """The first n rows of each kind; a row counts for the first kind that it fits."""
    from pyspark.sql.window import Window

    kind = F.lit(None).cast("string")
    for name, fits in reversed(kinds):
        kind = F.when(fits, name).otherwise(kind)
    r = rows.withColumn("kind", kind).where("kind is not null")
    return r.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(order))).where(F.col("k") <= n).drop("k")


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text line per row, for a table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("??")) for c in columns]), F.lit(" |")).alias("line"))
