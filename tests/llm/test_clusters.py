"""Centroid clustering against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries_near, yinyang


def brute(rows, k=16, rounds=3, width=64):
    """Rows of (id, cluster, distance), and the centroids, by full scans in plain integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def checked(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "cluster": F.lit(1)}).repartition(parts)
    found = yinyang.cluster(df, **options)
    want, centroids = brute(rows, options.get("k", 16), options.get("rounds", 3), options.get("width", 64))
    got = yinyang.with_inertia(found).collect()
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(want, key=str)
    assert found.centroids.tolist() == centroids
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    return found


def clustered(n=600, width=64, heads=12, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(heads, width))
    return [(k, (at[k % heads] + rng.normal(scale=0.2, size=width)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [4096, 50])
def test_rounds_equal_full_scans(spark, block):
    found = checked(spark, clustered(), block=block)
    scanned = found.blocks.agg(F.sum("scanned")).first()[0]
    assert 600 * 16 <= scanned < 2 * 600 * 16  # one full scan, and far less than one in the three rounds after it


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    # few distinct small integers, so that many distances are equal; copies; rows that repeat an id
    rows = [(k % 150, (rng.integers(-1, 2, 64) * (k % 3) / 64).astype(np.float32).tolist()) for k in range(300)]
    rows += rows[:20] + [(7, [0.0] * 64)] * 40
    rows += [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, [None] + [0.1] * 63), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, []), (None, [0.25] * 64), (907, [-0.001] * 64)]
    checked(spark, rows)


def test_fewer_vectors_than_clusters_and_large_components(spark):
    checked(spark, [(1, [0.5] * 64), (1, [0.5] * 64), (2, [3000.0] * 64), (3, [-250000.0] * 64), (4, [250000.0] * 64)])
    checked(spark, [(None, [0.5, 1.0]), (3, [9.0, 9.0])], width=2)
    assert yinyang.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")) is None
    wide = yinyang.cluster(spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>"), k=1)
    assert all(0 <= r["distance"] < 2**63 for r in yinyang.assigned(wide).collect())


def test_many_rounds_and_groups(spark):
    checked(spark, clustered(400, 8, 30, 5), k=40, rounds=6, width=8, block=64)


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, _ = brute(rows)
    got = queries_near.op11_yinyang(spark, data).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)


def test_query_of_an_empty_table(spark, data, tmp_path):
    spark.read.parquet(f"{data}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries_near.op11_yinyang(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0
