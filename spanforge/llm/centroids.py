"""Operator 11: exact integer k-means over distinct vectors with multiplicities.

Components become integers, floor(scale * x), so that all sums are exact and no run depends on the order
of rows. Equal quantised vectors are one row with a weight; Lloyd's rounds run over these distinct rows
alone. A round is one scan: every task adds up weighted components by nearest centroid in numpy and
emits k * (dims + 1) sums, and only these, k * (dims + 1) numbers whatever the table's size, reach the
driver. Assignments are computed once for each distinct vector and joined back to the rows by the
vector; a vector that a large share of all rows have is dealt over several tasks there.

Edge cases: vectors that are null, of another length, or with a null or non-finite component are left
out; repeated rows count each, also as first centroids; a row with a null vec_id is clustered like any
other but never is a first centroid; with fewer than k rows with ids there are as many clusters as such
rows, and without any the result is empty, as for an empty table; ties go to the smaller cluster. A component of 2**17
or more (after scaling 2**27) has distances that a long can't hold: that is an error. Other columns
than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Quantised components below this have squared distances in a long; below the second one, in a double without rounding.
LIMIT, EXACT = 1 << 27, 1 << 22


def _packed(q: np.ndarray) -> list[bytes]:
    """Rows as little-endian integers: of 16 bits where all components fit, else of 32. Equal rows have equal bytes."""
    if q.size and np.abs(q).max() >= LIMIT:
        raise ValueError(f"a quantised component is beyond {LIMIT}: squared distances would not fit 64 bits")
    narrow = ((q >= -32768) & (q < 32768)).all(axis=1)
    return [(row.astype("<i2") if s else row.astype("<i4")).tobytes() for row, s in zip(q, narrow.tolist(), strict=True)]


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    narrow = np.fromiter((len(r) == 2 * dims for r in rows), bool, len(rows))
    out = np.empty((len(rows), dims), np.int64)
    for width, which in (("<i2", narrow), ("<i4", ~narrow)):
        out[which] = np.frombuffer(b"".join(rows[k] for k in np.flatnonzero(which)), width).reshape(-1, dims)
    return out


def quantised(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """(vec_id, q binary) of the usable rows."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            ids, lists = ids.filter(right), lists.filter(right)
            x = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null is NaN here
            usable = np.isfinite(x).all(axis=1)
            scaled = np.floor(scale * x[usable])
            if scaled.size and np.abs(scaled).max() >= LIMIT:
                raise ValueError(f"a quantised component is beyond {LIMIT}: squared distances would not fit 64 bits")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(usable)), pa.array(_packed(scaled.astype(np.int64)), pa.binary())], ["vec_id", "q"])

    return common.map_arrow(vectors.select("vec_id", "embedding"), run, f"vec_id {kind}, q binary")


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of integer rows, exactly; the smaller number on ties."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:  # all products and sums are below 2**53
        x, c = q.astype(float), centroids.astype(float)
        d = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        d = np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(q)), best]


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED, dims: int = DIMS) -> np.ndarray:
    """The k rows with the smallest sha256 of '<seed>:<vec_id>', in that order; equal ids by their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").select(order.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return _unpacked(pa.array([bytes(r.q) for r in found], pa.binary()), dims)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors; those without vectors stay."""
    k, dims = centroids.shape

    def sums(batches):
        total = np.zeros((k, dims + 1), np.int64)  # the last column counts
        for batch in batches:
            q, n = _unpacked(batch.column(0), dims), batch.column(1).to_numpy()
            best, _ = nearest(q, centroids)
            for c in np.unique(best):
                of = best == c
                total[c, :dims] += n[of] @ q[of]
                total[c, dims] += n[of].sum()
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d], pa.int64())], ["c", "d", "s"])

    out = centroids.astype(object)
    parts = common.map_arrow(distinct.select("q", "n"), sums, "c int, d int, s long")
    found = {(r.c, r.d): int(r.s) for r in parts.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # k * (dims + 1) rows at most
    for c in range(k):
        if count := found.get((c, dims)):
            out[c] = [found.get((c, d), 0) // count for d in range(dims)]
    return out.astype(np.int64)


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after the rounds; once a round moves none, later ones wouldn't either."""
    for _ in range(rounds):
        new = moved(distinct, centroids)
        if (new == centroids).all():
            break
        centroids = new
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster int, distance long) of distinct vectors."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            best, d = nearest(_unpacked(batch.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(d, pa.int64())], ["q", "n", "cluster", "distance"])

    return common.map_arrow(distinct.select("q", "n"), run, "q binary, n long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, copies), one row per usable row; copies: rows with the same quantised vector."""
    rows = common.saved(quantised(vectors, dims, scale), "quantised")
    centroids = first_centroids(rows, k, seed, dims)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return rows.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "0L AS copies").withColumn("vec_id", F.col("vec_id").cast(kind))
    distinct = common.saved(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    centroids = lloyd(distinct, centroids, rounds)
    table = common.saved(assigned(distinct, centroids).withColumn("copies", F.col("n")), "assigned")
    whole = table.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance")).alias("inertia"), F.sum("n").alias("n")).collect()  # k rows at most
    inertia = {r.cluster: int(r.inertia or Decimal(0)) for r in whole}
    per = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    out = common.join_unique(rows, table, "q", sum(r.n for r in whole))
    return out.select(
        "vec_id", "cluster", "distance", per([inertia.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), per(digests).alias("centroid_sha256"), "copies")
