import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import centroids, common

VEC = "vec_id bigint, embedding array<double>, label int, q string, n string, cluster string, row string"


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(v, [math.floor(scale * x) for x in e]) for v, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"{seed}:{v}".encode()).hexdigest(), q) for v, q in kept if v is not None)[:k]
    c = [q for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for i in range(len(c)):
            mine = [q for (_, q), j in zip(kept, of, strict=True) if i == j]
            if mine:
                c[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(q) for _, q in kept]
    total = Counter()
    for d, i in last:
        total[i] += d
    return Counter((v, i, d, total[i], sum(total.values()), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest()) for (v, _), (d, i) in zip(kept, last, strict=True))


def got(rows):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows.collect())


@pytest.mark.parametrize("dims", [3, 8])
def test_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(300, dims)), 2)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500 + k, x[0].tolist()) for k in range(200)] + [(7, x[7].tolist()), (7, x[8].tolist()), (None, x[9].tolist()), (None, x[0].tolist())]
    rows += [(900, None), (901, []), (902, [0.0] * (dims + 1)), (903, [None] + [0.0] * (dims - 1)), (904, [math.nan] * dims), (905, [math.inf] * dims), (906, [-0.0] * dims), (907, [100_000.5] * dims)]
    table = spark.createDataFrame([(v, e, 1, "a", "b", "c", "d") for v, e in rows], VEC).repartition(5)
    out = centroids.cluster(table, k=4, rounds=6, dims=dims)
    assert got(out) == brute(rows, 4, 6, dims)
    assert out.where("vec_id = 500").first().copies == 202


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(1, [0.5, 1.0], 1, "", "", "", ""), (None, [0.5, 9.0], 1, "", "", "", "")], VEC)
    assert got(centroids.cluster(table, k=4, rounds=3, dims=2)) == brute([(1, [0.5, 1.0]), (None, [0.5, 9.0])], 4, 3, 2)
    none = centroids.cluster(table.limit(0), dims=2)
    assert none.collect() == [] and none.dtypes == centroids.cluster(table, k=1, dims=2).dtypes
    assert centroids.cluster(table.where("vec_id is null"), dims=2).collect() == []


def test_empty_clusters_stay_and_ties_go_to_the_smaller(spark):
    q = np.array([[0, 0], [2, 0], [1, 0]])
    assert centroids.nearest(q, np.array([[0, 0], [2, 0], [0, 0]]))[0].tolist() == [0, 1, 0]
    rows = [(k, [float(k % 2), 0.0]) for k in range(40)]  # two distinct vectors, four centroids
    table = spark.createDataFrame([(v, e, 1, "", "", "", "") for v, e in rows], VEC)
    assert got(centroids.cluster(table, k=4, rounds=5, dims=2)) == brute(rows, 4, 5, 2)


def test_large_components(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(-centroids.LIMIT + 1, centroids.LIMIT, (50, 64))
    c = rng.integers(-centroids.LIMIT + 1, centroids.LIMIT, (5, 64))
    best, d = centroids.nearest(q, c)
    for row, i, x in zip(q.tolist(), best.tolist(), d.tolist(), strict=True):
        each = [sum((a - b) ** 2 for a, b in zip(row, y, strict=True)) for y in c.tolist()]
        assert x == min(each) and i == each.index(x)
    table = spark.createDataFrame([(1, [1e9, 0.0], 1, "", "", "", "")], VEC)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(table, dims=2).collect()


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 10 > 0, F.lit(-1)).otherwise(F.col("id")).alias("key"))
    unique = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.col("key") * 2)
    for how in ("inner", "left"):
        out = common.join_unique(rows, unique.where("key <> 20"), "key", 60_000, how)
        assert out.count() == (60_000 if how == "left" else 59_999)
        assert out.where("value <> key * 2").count() == 0
    shares = unique.where("key = -1").select((F.col("n") * common.HOT_SHARE / 60_000).alias("s")).first().s
    assert shares > 200
