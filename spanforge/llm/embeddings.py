"""Operator 3: embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated once by a random orthogonal matrix and stored as the signs of its coordinates,
one bit each, with a correction factor f, the cosine between the vector and its code. The code's inner
product with another rotated vector over f estimates the cosine of the two without bias; it is off by at
most sin(angle) * sqrt(1 - f**2) / f, whatever that vector. The bound is used at full confidence: only
pairs that it proves to be below the threshold are dropped. The other side of the product is the
rotated vector in 16-bit steps, whose error is bounded too: of the pairs that are left, those above or
below the threshold by more than that error are decided in the task, and the few in between are computed
again in double precision from the vectors themselves, fetched by their ids. Neither vectors nor
anything else of eight bytes a coordinate is shipped to the cells.

Candidates share a cell, the signs of the first coordinates under a further rotation; several rotations
give several tables of cells, as many as the wanted recall at the threshold needs. With missed=0 all
vectors share one cell and no link can be missed. Equal vectors are compared once. A cell beyond a bound
is split into blocks, and every pair of blocks is a task. A task counts links and lists only edges of a
spanning forest; a pair that an earlier table has in one cell is left to it.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and vectors of different lengths don't either; repeated rows are linked copies; a null
vec_id counts for links but never names a component unless all its rows lack one; an empty table
gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

#: Cosine that links; chance to miss a pair exactly there; vectors of a cell on average, and of a block; rows compared at once.
THRESHOLD, MISSED, CELL, BLOCK, ROWS = 0.95, 1e-4, 2048, 4096, 256
#: Steps of a coordinate's 16-bit form.
STEPS = 32767


@lru_cache(64)
def rotation(dim: int, table: int) -> np.ndarray:
    """A random orthogonal matrix; the same for the same arguments everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, table]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float = THRESHOLD, missed: float = MISSED, cell: int = CELL) -> tuple[int, int]:
    """(bits of a cell's key, tables): a pair at the threshold has all bits equal in no table with probability `missed` at most."""
    bits = max(0, min(31, math.ceil(math.log2(max(1, n) / cell)))) if missed > 0 else 0
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(missed) / math.log1p(-same)))


def code(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, correction factors, 16-bit coordinates, their steps) of rotated unit vectors."""
    turned = unit @ rotation(unit.shape[1], 0)
    step = np.abs(turned).max(1) / STEPS
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1]), np.rint(turned / step[:, None]).astype("<i2"), step


def _links(signs: np.ndarray, f: np.ndarray, short: np.ndarray, step: np.ndarray, keys: np.ndarray, table: int, mine: np.ndarray, others: np.ndarray, same: bool, threshold: float):
    """(i, j, sure) of pairs of rows mine x others that are linked, or may be, in pieces; same: the two lists are one, each pair once."""
    dim = short.shape[1]
    turned = (short * step[:, None]).astype(np.float32)
    codes = (np.unpackbits(signs[others], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    off = f[others]
    bound = threshold - math.sqrt(max(0.0, 1 - threshold * threshold)) * np.sqrt(np.maximum(0, 1 - off * off)) / off
    # compared before the division by f; a coordinate is off by half a step
    least = (bound * off - step.max() / 2 * math.sqrt(dim) - 1e-5).astype(np.float32)
    for at in range(0, len(mine), ROWS):
        part = mine[at : at + ROWS]
        from_ = at + 1 if same else 0
        i, j = np.nonzero(turned[part] @ codes[from_:].T >= least[from_:])
        j += from_
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        a, b = part[i], others[j]
        if table and len(a):
            first = ~(keys[a, :table] == keys[b, :table]).any(1)
            a, b = a[first], b[first]
        near = np.einsum("ij,ij->i", short[a].astype(np.float64), short[b].astype(np.float64)) * step[a] * step[b]
        slack = (step[a] + step[b]) / 2 * math.sqrt(dim) + dim * step[a] * step[b] + 1e-9
        good = near >= threshold - slack
        yield a[good], b[good], (near >= threshold + slack)[good]


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unites a and b in the forest `parent`, in place; the edges that did it."""
    out_a, out_b = [], []
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        high, first = np.unique(np.maximum(ra, rb), return_index=True)
        parent[high] = np.minimum(ra, rb)[first]
        out_a.append(a[first])
        out_b.append(b[first])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    none = np.empty(0, np.int64)
    return np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none


CODED = "gid long, w long, d int, signs binary, f float, short binary, step float, keys array<int>"


def coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """The stored codes of (gid, embedding, w): CODED columns, with the key of each table's cell."""

    def made(batches):
        for batch in batches:
            gid, w = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1)[:, None]  # so that no square overflows or vanishes
                unit = x / np.sqrt((x * x).sum(1))[:, None]
                signs, f, short, step = code(unit)
                # a factor or step that is rounded up or down must not make a bound too sharp
                f = np.nextafter(f.astype(np.float32), np.float32(0))
                weights = 1 << np.arange(min(bits, dim), dtype=np.int64)
                keys = np.stack([(unit @ rotation(int(dim), t + 1)[:, : len(weights)] >= 0) @ weights if bits else np.zeros(len(unit)) for t in range(tables)], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.reshape(-1)))
                binary = lambda v: pa.array([r.tobytes() for r in v], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(gid[rows]), pa.array(w[rows]), pa.array(np.full(len(rows), dim, np.int32)), binary(signs), pa.array(f, pa.float32()), binary(short), pa.array(step.astype(np.float32)), lists], [c.split()[0] for c in CODED.split(", ")])

    return common.map_arrow(vectors.select("gid", "embedding", "w"), made, CODED)


def links(vectors: DataFrame, n: int, threshold: float = THRESHOLD, missed: float = MISSED, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(a, b, n): b null: a has n more linked rows; n = 0: an edge between a and b; n = -1: the pair has to be computed again.

    vectors: (gid long, embedding array<double>, w long), distinct, finite and not zero; n: how many.
    """
    bits, tables = plan(n, threshold, missed, cell)
    rows = common.saved(coded(vectors, bits, tables), "codes")
    light = rows.select("d", F.posexplode("keys").alias("t", "key")).withColumn("cell", F.xxhash64("d", "t", "key"))
    heavy = common.saved(light.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("m")), "heavy")
    cells = rows.select("*", F.posexplode("keys").alias("t", "key")).withColumn("cell", F.xxhash64("d", "t", "key")).drop("key")
    cells = cells.join(heavy, "cell", "left") if not heavy.isEmpty() else cells.withColumn("m", F.lit(1))
    m = F.coalesce(F.col("m"), F.lit(1))
    mine = F.pmod(F.xxhash64("gid"), m).cast("int")
    cells = cells.withColumn("mine", mine).withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(F.least(F.col("mine"), j).alias("lo"), F.greatest(F.col("mine"), j).alias("hi")))))

    def compared(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lo, hi, table, dim = key[1].as_py(), key[2].as_py(), t.column("t")[0].as_py(), t.column("d")[0].as_py()
        gid, w, side = (t.column(c).to_numpy() for c in ("gid", "w", "mine"))
        raw = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(gid), -1)
        f, step = t.column("f").to_numpy().astype(np.float64), t.column("step").to_numpy().astype(np.float64) * (1 + 1e-6)
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(gid), -1)
        count, parent, pairs = np.zeros(len(gid), np.int64), np.arange(len(gid)), []
        rows = np.arange(len(gid))
        same = lo == hi
        for a, b, sure in _links(raw("signs", np.uint8), f, raw("short", "<i2"), step, keys, table, rows if same else rows[side == lo], rows if same else rows[side == hi], same, threshold):
            pairs.append((a[~sure], b[~sure], -1))
            a, b = a[sure], b[sure]
            np.add.at(count, a, w[b])
            np.add.at(count, b, w[a])
            pairs.append((*_joined(parent, a, b), 0))
        some = np.flatnonzero(count)
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
        kind = np.concatenate([np.full(len(p[0]), p[2], np.int64) for p in pairs]) if pairs else np.empty(0, np.int64)
        first = pa.array(np.concatenate((gid[some], gid[a])))
        second = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(gid[b])])
        return pa.Table.from_arrays([first, second, pa.array(np.concatenate((count[some], kind)))], ["a", "b", "n"])

    common.ready(vectors.sparkSession)
    return cells.select("cell", F.col("task.lo").alias("lo"), F.col("task.hi").alias("hi"), "t", "gid", "w", "d", "mine", "signs", "f", "short", "step", "keys").groupBy("cell", "lo", "hi").applyInArrow(compared, "a long, b long, n long")


def recomputed(pairs: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n) as `links` gives them, of the pairs (a, b) whose cosine in double precision reaches the threshold."""
    side = lambda k: vectors.select(F.col("gid").alias(k), F.col("embedding").alias(f"x{k}"), F.col("w").alias(f"w{k}"))
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    cosine = f"{dot('xa', 'xb')} / sqrt({dot('xa', 'xa')} * {dot('xb', 'xb')})"
    good = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{cosine} >= {threshold}D")
    return good.select(F.inline(F.array(F.struct("a", F.lit(None).cast("long").alias("b"), F.col("wb").alias("n")), F.struct(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.col("wa").alias("n")), F.struct("a", F.col("b").alias("b"), F.lit(0).cast("long").alias("n")))))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, missed: float = MISSED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    e = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.0)  # one zero, not two
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(good, F.col("embedding")).alias("embedding")).withColumn("h", F.xxhash64("embedding"))
    groups = rows.where("embedding is not null").groupBy("h", "embedding").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    groups = common.saved(groups.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    found = common.saved(links(groups, groups.count(), threshold, missed), "links")
    found = found.where("n >= 0").unionByName(recomputed(found.where("n < 0").select("a", "b"), groups, threshold))
    found = common.saved(found, "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    names = common.component_names(found.where("b is not null").select("a", "b"), groups.select(F.col("gid").alias("node"), F.col("least").alias("value")))
    g = groups.join(counts, groups["gid"] == counts["a"], "left").join(names, groups["gid"] == names["node"], "left")
    g = g.select(F.col("h").alias("gh"), F.col("embedding").alias("ge"), (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.when(F.col("node").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("named"))
    out = rows.join(g, (rows["h"] == g["gh"]) & (rows["embedding"] == g["ge"]), "left")
    component = F.when(F.col("gh").isNotNull(), F.col("named")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
