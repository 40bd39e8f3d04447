"""Operator 8: mixes sources to target weights by cube-method balanced sampling.

A source's target over its size is a number of copies; whole copies go to every document, and the
fraction is an inclusion probability. The cube method moves these probabilities along the null
space of the constraints (documents and words of the source) until each is 0 or 1, so a source's
taken documents and words stay what they were. That flight runs in hashed blocks of bounded size;
each block leaves at most two probabilities undecided, these meet in blocks again, and a last
block per source lands the rest.

Edge cases: null text has size 0; a null source is a source of its own, the last; sources without
words have target 0 and nothing is taken from them; repeated rows are documents of their own (the
k-th of equal rows draws its own lot, so however many there are, they fly in blocks of bounded size);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm import common

WEIGHTS, MOST, BLOCK, EXCHANGES = (5, 2, 1), 3, 4096, 4


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size).

    The weights repeat over the sources in code-point order, null last. All words are shared by
    weight; a target above `most` times its source's size stops there and the others share the
    excess, again and again. What that ends in is found at once: sources fill up in the order of
    cap / weight, and the level of the rest is what remains over the weight that remains. The
    windows run over one row per source.
    """
    cycle = "array(" + ",".join(f"{float(w)}D" for w in weights) + ")"
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.selectExpr("source", "source_size", "n_docs", "k", f"{cycle}[cast((k - 1) % {len(weights)} as int)] as w", f"cast({most} as double) * source_size as cap")
    up = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before, all_ = up.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    full = F.col("level") * F.col("w") >= F.col("cap")
    level = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("source", "source_size", "n_docs", F.when(full, F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, seed: np.ndarray) -> None:
    """Moves probabilities, in place, along the null space of (1, size) until at most two are inside (0, 1).

    Three undecided units always have such a direction: u = (s2 - s3, s3 - s1, s1 - s2), or a plain
    exchange of the first two where the sizes are equal. The two step lengths reach the cube's faces;
    which one is taken is drawn so that every probability keeps its mean.
    """
    eps = 1e-9
    live: list[int] = []
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            p[k] = round(p[k])
            continue
        live.append(k)
        while len(live) >= 3:
            i, j, m = live
            u = (float(size[j] - size[m]), float(size[m] - size[i]), float(size[i] - size[j]))
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[x]) / y if y > 0 else p[x] / -y) for x, y in zip(live, u, strict=True) if y)
            down = min((p[x] / y if y > 0 else (1 - p[x]) / -y) for x, y in zip(live, u, strict=True) if y)
            draw = _unit(int(seed[i]) ^ 3 * int(seed[j]) ^ 5 * int(seed[m]))
            step = up if draw * (up + down) < down else -down
            rest = []
            for x, y in zip(live, u, strict=True):
                p[x] = min(1.0, max(0.0, p[x] + step * y))
                if p[x] <= eps or p[x] >= 1 - eps:
                    p[x] = round(p[x])
                else:
                    rest.append(x)
            if len(rest) == 3:  # a face was missed by rounding
                x = min(rest, key=lambda r: min(p[r], 1 - p[r]))
                p[x] = round(p[x])
                rest.remove(x)
            live = rest


def _unit(x: int) -> float:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 33)) / 2.0**64


def landing(p: np.ndarray, size: np.ndarray, words: float) -> None:
    """Decides the last few: of all ways, the one whose words are nearest to `words`, then whose documents.

    A large document among the last two could leave a gap, so a few exchanges of a taken document
    for another, the one that closes the gap best, follow where they help.
    """
    live = np.flatnonzero((p > 0) & (p < 1))
    if len(live):
        ways = np.array(np.meshgrid(*[[0, 1]] * len(live))).reshape(len(live), -1).T
        off = np.abs(ways @ size[live] + size[p == 1].sum() - words)
        p[live] = ways[np.lexsort((np.abs(ways.sum(1) - p[live].sum()), off))[0]]
    for _ in range(EXCHANGES):
        gap = words - size[p == 1].sum()
        out, rest = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(out) or not len(rest):
            return
        rest = rest[np.argsort(size[rest], kind="stable")]
        at = np.searchsorted(size[rest], size[out] + gap)
        near = np.stack((np.clip(at - 1, 0, len(rest) - 1), np.clip(at, 0, len(rest) - 1)))
        left = np.abs(size[rest][near] - size[out] - gap)
        side, k = np.unravel_index(left.argmin(), left.shape)
        if left[side, k] >= abs(gap):
            return
        p[out[k]], p[rest[near[side, k]]] = 0, 1


ROWS = "id long, tag long, source string, size long, source_size long, target double, whole long, p double, h long"


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """Adds k, 0 to n - 1 over n equal rows. They are counted and made again, so a hot one needs no sort; many come from several tasks."""
    n = common.saved(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "sizes")  # a whole scan made them
    parts = n.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    parts = parts.where("n <= 1").unionByName(parts.where("n > 1").repartition(F.xxhash64(*parts.columns)))
    last = F.least(F.col("n") - F.col("part") * block, F.lit(block)) - 1
    return parts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("k", F.col("part") * block + F.col("k")).drop("n", "part")


def balanced_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """(id, tag, source, size, source_size, target, copies) for rows of (id, source, size) and maybe tag: how often the mix takes each.

    Documents fly in the order of falling size, so the undecided ones at a block's end are small.
    """
    tag = F.col("tag") if "tag" in rows.columns else F.lit(None)
    rows = rows.select(F.col("id").cast("long").alias("id"), tag.cast("long").alias("tag"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"))
    rows = _numbered(rows, block)
    targets = common.saved(source_targets(rows, weights, most), "targets")
    t = targets.withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    now = rows.join(t, rows["source"].eqNullSafe(t["s"])).select("id", "tag", "source", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), F.xxhash64("id", "tag", "source", "size", "k").alias("h"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).alias("blocks"))
    sure = now.where("p <= 1e-9 or p >= 1 - 1e-9").withColumn("p", F.round("p"))
    names = [x.split()[0] for x in ROWS.split(", ")]
    done = [sure.select(*names)]
    now = now.where("p > 1e-9 and p < 1 - 1e-9")
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    while True:
        last = land = most_docs <= block

        def fly(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            t = t.sort_by([("size", "descending"), ("h", "ascending"), ("id", "ascending"), ("p", "ascending")])
            p, size = t.column("p").to_numpy().copy(), t.column("size").to_numpy()
            words = float((p * size).sum())
            flight(p, size, t.column("h").to_numpy().astype(np.uint64) + np.arange(len(p), dtype=np.uint64))
            if land:
                landing(p, size, words)
            return t.select(names).set_column(names.index("p"), "p", pa.array(p))

        common.ready(rows.sparkSession)
        dealt = now.withColumn("b", F.pmod(F.xxhash64("h", "blocks"), F.col("blocks")))
        flown = dealt.groupBy("source", "b").applyInArrow(fly, ROWS)
        if last:
            done.append(flown)
            break
        flown = common.saved(flown, "flight")
        done.append(flown.where("p = 0 or p = 1"))
        # at most two rows a block go on; their blocks are counted anew
        most_docs = 2 * -(-most_docs // block)
        now = flown.where("p > 0 and p < 1").withColumn("blocks", F.lit(max(1, -(-most_docs // block))).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "tag", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def _text_tag() -> Column:
    return F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words that the mix takes of each document, repeats counted."""
    # the text's hash, as in `mixed`, so that both draw alike
    rows = docs.select(F.col("doc_id").alias("id"), _text_tag().alias("tag"), "source", n_words(F.col("text").cast("string")).alias("size"))
    return balanced_mix(rows, weights, most).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The documents, all columns kept, each as often as the mix takes it.

    Documents meet their fate by doc_id and a hash of their text, two longs; texts are shuffled only if that
    table is large. Of rows equal in both, source and size, one stands for all, and is repeated as often as they were taken together.
    """
    size = n_words(F.col("text").cast("string"))
    text = _text_tag()
    fate = balanced_mix(docs.select(F.col("doc_id").alias("id"), text.alias("tag"), "source", size.alias("size")), weights, most)
    fate = fate.groupBy("id", "tag", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    fate = common.saved(fate, "fate").withColumnsRenamed({"id": "f_id", "tag": "f_tag", "source": "f_source", "size": "f_size"})
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("k_id"), text.alias("k_tag"), docs["source"].cast("string").alias("k_source"))
    # null ids and texts are keys too: 0 beside a mark
    key = lambda c: [F.coalesce(F.col(c), F.lit(0).cast("long")), F.col(c).isNull()]
    pairs = [a == b for x in ("id", "tag") for a, b in zip(key(f"k_{x}"), key(f"f_{x}"), strict=True)]
    met = rows.join(fate, pairs + [F.col("k_source").eqNullSafe(F.col("f_source"))])
    once = met.where("n = 1")
    many = met.where("n > 1")
    if not fate.where("n > 1").isEmpty():
        once = once.unionByName(many.dropDuplicates(["k_id", "k_tag", "k_source"]))
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
